"""Structured Streaming: record streams in, scored rows and window metrics out."""
