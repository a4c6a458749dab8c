"""Column expressions and join helpers."""
