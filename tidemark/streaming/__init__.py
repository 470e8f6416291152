"""Structured Streaming over lines: an addition to the batch engine."""
