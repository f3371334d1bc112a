"""Sources of the question bank."""
