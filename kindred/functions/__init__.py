"""Column-level functions: text cleaning, vectors, distances."""
