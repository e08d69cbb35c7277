"""Column functions: patterns, checksums, spans, substitutes."""
