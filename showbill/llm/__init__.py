"""Operators for large text corpora, each a function of DataFrames."""
