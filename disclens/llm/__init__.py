"""Operators of a training-data pipeline over the text of source documents."""
