"""Operators for the text and statistics of training data. Nothing outside imports this package."""
