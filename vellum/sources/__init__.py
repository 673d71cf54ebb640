"""vellum.sources."""
