"""Column functions: text, genres, ISBNs, bytes."""
