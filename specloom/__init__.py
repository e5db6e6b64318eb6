"""Specification analytics as Spark DataFrame jobs."""
