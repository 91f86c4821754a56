"""Operators of a training-data pipeline: one module an operator, ``entry`` registers their queries."""
