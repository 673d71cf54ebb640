"""vellum.streaming."""
