"""Readers for tables, boundaries and grids, and the store of named results."""
