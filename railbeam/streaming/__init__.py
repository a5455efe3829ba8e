"""The movement feed as Structured Streaming queries."""
