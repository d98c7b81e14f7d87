"""Census mapping analytics as Spark DataFrame jobs and Structured Streaming queries."""
