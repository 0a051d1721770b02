"""Operators for preparing training text, each over whole tables of documents.

Nothing else in the package imports this one. `queries` registers them.
"""
