"""Fact reconciliation on Spark: normalise, ground, key, link and view facts, as DataFrames."""
