"""Operators on rows of a pattern and on edge tables."""
