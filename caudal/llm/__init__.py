"""Operators on text and entities for training data. Nothing else in the library imports this package."""
