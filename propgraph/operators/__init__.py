"""Operators on node sets, vectors and edges."""
