"""Struklake: receipt extraction and table-scale text work on Spark DataFrames."""
