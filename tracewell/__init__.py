"""Lineage analytics over Spark DataFrames."""
