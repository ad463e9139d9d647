"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; ``registry`` holds the queries and their SQL.
"""
