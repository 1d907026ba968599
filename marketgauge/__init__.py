"""Retail price and demand analytics on Spark DataFrames."""
