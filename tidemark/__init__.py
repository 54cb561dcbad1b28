"""A stream-analytics engine on Spark DataFrames and Structured Streaming."""
