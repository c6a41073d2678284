"""Structured Streaming jobs that keep the log live."""
