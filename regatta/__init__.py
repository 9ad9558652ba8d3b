"""Tabular regression analytics on Spark DataFrames."""
