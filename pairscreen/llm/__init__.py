"""Operators of a training-data pipeline over texts, vectors, pages and
conversations.  Nothing else in the package imports this folder."""
