"""Functions of the question bank."""
