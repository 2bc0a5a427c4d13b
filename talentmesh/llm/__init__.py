"""Operators for training-data pipelines over documents and pages.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
