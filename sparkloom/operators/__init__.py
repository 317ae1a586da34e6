"""Operators from DataFrames to DataFrames; every order ends in a unique tie-break."""
