"""Corpus operators for large-scale training-data preparation.

The subpackage is self-contained: no other module of the library imports it.
"""
