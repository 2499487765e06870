"""Structured Streaming: landing to bronze and incremental marts."""
