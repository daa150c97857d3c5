"""Posting analytics on Spark DataFrames."""
