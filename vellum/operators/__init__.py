"""vellum.operators."""
