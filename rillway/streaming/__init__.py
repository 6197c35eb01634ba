"""Structured Streaming forms of the bus operators."""
