"""Column expressions and byte formats."""
