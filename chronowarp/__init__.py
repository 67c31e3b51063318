"""Elastic time-series distances, lower bounds and similarity search as Spark DataFrame operations."""
