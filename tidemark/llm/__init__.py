"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator is a function from
DataFrames to a DataFrame; the thin contract queries are in :mod:`tidemark.llm.queries`.
"""
