"""Readers and writers of matrix files, and generated matrices."""
