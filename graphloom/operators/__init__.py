"""Operators over graphs and hypergraphs."""
