"""The public queries and jobs."""
