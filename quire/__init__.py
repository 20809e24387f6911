"""Document structure and retrieval engine on PySpark."""
