"""vellum: document-intelligence operators for PySpark."""
