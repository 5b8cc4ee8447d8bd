"""Operators of the fact layer, each a function of DataFrames."""
