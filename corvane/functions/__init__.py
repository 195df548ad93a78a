"""Column functions: text, hashing and small statistics."""
