"""Timed-text alignment and quality analytics on Spark DataFrames."""
