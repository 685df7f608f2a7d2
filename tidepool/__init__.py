"""A retrieval and analytics engine whose operators are Spark DataFrame plans."""
