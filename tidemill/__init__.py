"""Analytics and corpus preparation written for Spark's DataFrame, SQL and Structured Streaming interfaces."""
