"""Media-stream analytics and corpus preparation as Spark DataFrame operations."""
