"""Operators of a training-data pipeline; nothing else in the library imports this package.

``catalogue`` registers their queries, one module per operator holds the operator itself.
"""
