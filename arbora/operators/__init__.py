"""Operators on point tables and rasters."""
