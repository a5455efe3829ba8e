"""Table operations: every one is a DataFrame in, DataFrame out plan."""
