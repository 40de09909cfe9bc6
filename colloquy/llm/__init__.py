"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may import general
helpers from the rest.
"""
