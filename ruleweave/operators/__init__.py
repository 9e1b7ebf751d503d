"""Evaluation, bounds, checking, mining and governance on DataFrames."""
