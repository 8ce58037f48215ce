"""Joins, windows, rollups and graph jobs over typed session tables."""
