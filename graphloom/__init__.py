"""Graphloom: a provenance-tracked property graph, queried and maintained with Spark DataFrames."""
