"""Raster operators as lazy DataFrame transformations."""
