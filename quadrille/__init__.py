"""Spatial-pattern analytics over rasters held as Spark DataFrames."""
