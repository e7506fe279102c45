"""Operators for training-data work on text and vectors.

Nothing outside this folder imports it.
"""
