"""Operators of a training-data pipeline. Nothing else in confora imports this package."""
