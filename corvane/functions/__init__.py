"""corvane functions."""
