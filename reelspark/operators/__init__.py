"""Catalogue operators: DataFrames in, DataFrame out."""
