"""corvane sources."""
