"""Corpus operators for building language-model training data.

Nothing else in the library imports this subpackage; its queries and their SQL
live in :mod:`turnlake.llm.queries`.
"""
