"""Reliability-data analytics and corpus preparation as PySpark DataFrame jobs."""
