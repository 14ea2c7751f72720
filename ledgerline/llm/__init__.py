"""Operators of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with a general interface; ``queries`` binds them to the
sample tables. Nothing outside this folder imports it.
"""
