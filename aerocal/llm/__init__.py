"""Operators for preparing training data from a corpus, each with one registered query."""
