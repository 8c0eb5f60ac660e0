"""Operators for large text corpora used as training data.

Nothing outside this package imports it.  Every operator takes DataFrames,
returns a lazy DataFrame and states in its docstring what it does with nulls,
empty and very long texts, ties, repeated rows, empty tables and extra columns.
"""
