"""Column expressions: text, vectors, arrays and scores."""
