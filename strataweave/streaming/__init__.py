"""Structured Streaming over commit touches."""
