"""Column functions: vectors, numbers, geometry."""
