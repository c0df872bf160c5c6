"""Structured Streaming versions of the stateless and windowed operators."""
