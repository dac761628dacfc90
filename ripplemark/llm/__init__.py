"""Operators for building large-scale training corpora.

Nothing else in the package imports this subpackage.
"""
