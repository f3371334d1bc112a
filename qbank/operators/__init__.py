"""Operators of the question bank."""
