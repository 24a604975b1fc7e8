"""Column expressions: analysis, scoring and text rendering."""
