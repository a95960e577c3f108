"""Log-incident analytics as Spark DataFrame and Structured Streaming jobs."""
