"""Operators on entries (i, j, v) and vectors (i, x). Everything is lazy unless said otherwise."""
