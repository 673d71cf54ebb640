"""vellum.functions."""
