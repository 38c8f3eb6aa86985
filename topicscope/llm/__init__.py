"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage.  Every operator works on
DataFrames of any size; the registered queries are in ``queries``.
"""
