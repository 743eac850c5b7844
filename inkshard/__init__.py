"""Markup-corpus and conversion-log analytics on Spark DataFrames."""
