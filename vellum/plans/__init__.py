"""vellum.plans."""
