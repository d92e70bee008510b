"""Terrain analytics expressed as Spark DataFrames."""
