"""Distributed dense linear algebra on Spark DataFrames."""
