"""Pairwise (dyadic) analysis of communities and social groups on Spark DataFrames."""

__version__ = "0.1.0"
