"""Operators for training-data corpora.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
