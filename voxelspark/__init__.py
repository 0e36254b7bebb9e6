"""Voxel world, raster pyramid and overlay analytics as Spark DataFrames."""
