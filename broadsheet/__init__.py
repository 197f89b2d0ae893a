"""Headline analytics on Spark: typed schemas, Column functions and DataFrame transforms."""
