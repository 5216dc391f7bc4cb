"""corvane operators."""
