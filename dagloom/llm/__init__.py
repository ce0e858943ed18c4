"""Operators for preparing language-model training corpora.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; :mod:`dagloom.llm.queries` binds them to the ``documents`` tables.
"""
