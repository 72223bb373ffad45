"""Structured Streaming versions of windowed operators."""
