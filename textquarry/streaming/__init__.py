"""Structured Streaming: documents as they arrive, counts over event time."""
