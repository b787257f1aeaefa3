"""tidemark: composable PySpark operators over an append-only log of user entries."""
