"""Operators on DataFrames: cleaning, weighted tables, indices, item response, driver models."""
