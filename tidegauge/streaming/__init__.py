"""Structured Streaming around the same functions that serve batch."""
