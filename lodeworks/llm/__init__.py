"""Operators for building training corpora: text in DataFrames, decisions out."""
