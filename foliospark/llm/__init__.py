"""Operators for preparing large text collections for model training.

Nothing else in the library imports this folder. Operators are functions from
DataFrames to a DataFrame; the registered queries are in ``queries``.
"""
