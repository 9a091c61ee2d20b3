"""Operators for preparing language-model training text on Spark.

Nothing else in the package imports this subpackage.
"""
