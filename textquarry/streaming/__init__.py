"""Structured Streaming: keep an index current from a stream of file changes."""
