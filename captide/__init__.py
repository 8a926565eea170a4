"""captide: transcript content analytics on PySpark."""
