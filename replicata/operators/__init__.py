"""Operators on DataFrames, one module for each section of the inventory."""
