"""Column-level functions: combiners, complex numbers, degrees of freedom, cost models."""
