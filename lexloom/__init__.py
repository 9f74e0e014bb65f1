"""Legal-text retrieval and evaluation on PySpark."""
