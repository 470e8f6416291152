"""Whole plans: ingest of a batch, prompts and cost, the store of analyses."""
