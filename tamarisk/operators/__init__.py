"""Relational, raster and zonal operators over DataFrames."""
