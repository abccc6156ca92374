"""Structured Streaming forms of ingestion, query logs and the answer cache."""
