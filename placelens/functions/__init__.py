"""Column expressions, fixed values and small shared DataFrame helpers."""
