"""Operators of a training-data pipeline: one module per operator, one query each in ``queries``."""
