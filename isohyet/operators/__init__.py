"""Operators on cubes, windows, recurrences, grids and trends as functions on DataFrames."""
