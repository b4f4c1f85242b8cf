"""Operators for preparing training corpora.

The subpackage is self-contained: nothing else in the library imports it, and
it can be removed without touching the literature operators.
"""
