"""flowmill: network-flow analytics on Spark DataFrames, SQL and Structured Streaming."""
