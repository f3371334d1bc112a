"""Plans of the question bank."""
