"""Compositions of operators: styling, pyramids, isometric views, sweeps."""
