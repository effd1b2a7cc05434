"""Operators of a training-data pipeline over documents, embeddings, pages and conversations.

Every module holds one operator with its own general interface; ``queries`` applies each to a
whole table.  Nothing outside this subpackage imports it.
"""
