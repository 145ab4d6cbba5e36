"""Operators over text corpora for training data. Nothing outside this package imports it."""
