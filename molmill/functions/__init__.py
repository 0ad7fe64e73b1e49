"""Column expressions and literal tables."""
