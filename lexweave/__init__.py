"""lexweave: document-archive analytics and corpus preparation on PySpark."""
