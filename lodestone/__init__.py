"""Lodestone: knowledge-graph and corpus analytics as plain Spark DataFrames."""
