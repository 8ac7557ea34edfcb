"""rankspark: ranked retrieval and evaluation as Spark DataFrame plans."""
