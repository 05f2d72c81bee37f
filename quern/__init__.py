"""quern: ranked-retrieval analytics expressed as Spark DataFrame plans."""
