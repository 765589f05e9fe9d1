"""Operators on texts for language models. Nothing else in the library imports this package."""
