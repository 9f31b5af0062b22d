"""Graph and hypergraph analytics expressed as Spark DataFrame plans."""
