"""Operators on documents for training data: packing, mixing, garbled text.

Nothing else in the library imports this subpackage.
"""
