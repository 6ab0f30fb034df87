"""Column expressions: geometry, overlap, strings."""
