"""Mention analytics on Spark DataFrames."""
