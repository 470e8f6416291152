"""Operators of the log engine, each from DataFrame to DataFrame."""
