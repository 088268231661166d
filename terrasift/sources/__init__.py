"""Readers of vector layers, and the writer of repaired ones."""
