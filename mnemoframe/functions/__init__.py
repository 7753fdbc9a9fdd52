"""Column expressions: text, time, similarity and nested values."""
