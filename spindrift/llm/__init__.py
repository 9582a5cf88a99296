"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries`` lists the
registered ``opN_*`` queries with their SQL where SQL can express them.
"""
