"""Evidence retrieval and text processing as Spark DataFrame plans."""
