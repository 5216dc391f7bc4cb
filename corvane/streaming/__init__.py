"""corvane streaming."""
