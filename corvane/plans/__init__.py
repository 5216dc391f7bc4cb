"""corvane plans."""
