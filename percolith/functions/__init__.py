"""Column functions: vectors and lattices, text and names, hashes."""
