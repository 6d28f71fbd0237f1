"""Structured Streaming forms of the loads."""
