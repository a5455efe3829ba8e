"""Column functions. All are built from Spark's own expressions and ignore the session time zone."""
