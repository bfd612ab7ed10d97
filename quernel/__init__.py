"""Retrieval, evidence and text analytics as lazy Spark plans."""
