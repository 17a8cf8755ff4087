"""Incident impact analytics on Spark DataFrames."""
