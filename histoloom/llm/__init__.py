"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries.py`` is the only
place that binds the operators to table names.
"""
