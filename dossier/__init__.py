"""Incident and taxonomy analytics as Spark DataFrame jobs."""
