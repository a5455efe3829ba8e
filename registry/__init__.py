"""The driver's queries: the engine run on the given tables, and the SQL they must equal."""
