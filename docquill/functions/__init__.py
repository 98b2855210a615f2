"""Column-level building blocks: typed values, expressions, patterns, text."""
