"""Sparse linear algebra over relations: a matrix is (i, j, v), a vector is (i, x)."""
