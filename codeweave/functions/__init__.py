"""Column expressions and per-language extractors."""
