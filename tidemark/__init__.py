"""Tidemark: log ingest and incident analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
