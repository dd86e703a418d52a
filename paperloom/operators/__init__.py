"""Relational operators over blocks, cells and grids."""
