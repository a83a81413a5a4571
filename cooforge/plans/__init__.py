"""Matrices with their dimensions, settings, lineage control, and the solver's stages."""
