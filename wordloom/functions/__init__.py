"""Column functions: text, hashing, vectors, classification outputs."""
