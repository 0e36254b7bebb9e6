"""Relational operators over voxel, column, tile and overlay tables."""
