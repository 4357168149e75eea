"""Operators for preparing large text corpora as training data.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
thin registered queries and ``oracle.py`` their SQL counterparts.
"""
