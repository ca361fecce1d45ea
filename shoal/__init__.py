"""Asset-stream analytics expressed as Spark DataFrame jobs."""
