"""Semantic, structural and temporal querying of text, markup and event data on Spark DataFrames."""
