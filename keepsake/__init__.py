"""Hybrid memory retrieval and corpus analytics as Spark plans."""
