"""Operators for training-data pipelines over ``documents``-like tables.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface; ``queries`` registers the thin ``opN_<name>`` ones.
"""
