"""SQL oracles: one text per query, written independently of the Spark operators."""
