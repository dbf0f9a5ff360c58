"""Customer-feedback analytics on PySpark."""
