"""Structured Streaming operators; each also runs on a batch DataFrame."""
