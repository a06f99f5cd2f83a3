"""Causal-text corpus preparation and evaluation on Spark DataFrames."""
