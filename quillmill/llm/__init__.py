"""Operators for building and checking model training data. Nothing else in the library imports this package."""
