"""Operators for preparing training corpora.

Self-contained: nothing outside this subpackage imports it, and it imports
nothing of the rest of the library.
"""
