"""Readers and writers: region files, palettes, overlays, assets, tiles."""
