"""Traffic-quality and fraud analytics expressed as Spark DataFrame jobs."""
