"""Column expressions: links, names and vectors."""
