"""Regulatory-corpus analytics as plain PySpark DataFrame jobs."""
