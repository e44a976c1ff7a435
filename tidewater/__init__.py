"""Event lakehouse and demand analytics expressed as Spark DataFrame jobs."""
