"""Operators of a training-data pipeline; see ``queries`` for the registered forms."""
