"""Near-duplicate retrieval as PySpark DataFrame operators."""
