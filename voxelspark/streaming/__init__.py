"""Structured Streaming jobs that keep tiles and overlays current."""
