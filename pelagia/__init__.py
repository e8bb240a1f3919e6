"""Gridded-field and training-data analytics on Spark DataFrames."""
