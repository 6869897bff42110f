"""Gridloom: packed gridded meteorology on Spark DataFrames."""
