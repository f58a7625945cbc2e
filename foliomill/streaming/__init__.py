"""Structured Streaming versions of the event and vote operators."""
