"""Layered lakehouse analytics on Spark DataFrames."""
