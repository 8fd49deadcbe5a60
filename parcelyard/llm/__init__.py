"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames, reads only the columns that it names and leaves others alone.
"""
