"""Data-quality and web-data analytics expressed as PySpark DataFrame jobs."""
