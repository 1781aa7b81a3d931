"""Operators of a training-data pipeline, one module each.

``queries.py`` holds the thin registered queries. Nothing outside this package
imports it; the package itself uses no other part of the library.
"""
