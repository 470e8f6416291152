"""Column functions: levels, timestamps and text pieces that parsers share."""
