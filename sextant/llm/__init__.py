"""Operators of a training-data pipeline: cleaning, matching, classifying and tokenising whole corpora.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
