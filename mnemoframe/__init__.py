"""Agent-memory analytics on Spark DataFrames."""
