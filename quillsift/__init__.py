"""Sensitive-data discovery and corpus preparation as Spark DataFrame operations."""
