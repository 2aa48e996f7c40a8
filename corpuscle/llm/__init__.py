"""Operators of a training-data pipeline over DataFrames of documents and pages.

Every module holds one operator; ``catalog`` registers the thin queries over the
driver's tables.  Nothing outside this subpackage imports it.
"""
