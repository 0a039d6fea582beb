"""Operators of a training-data pipeline over the ``documents``, ``labels`` and ``embeddings`` tables.

Each module holds one operator and works on any DataFrame with the columns it names; ``queries``
applies them to whole tables. Nothing else in the library imports this package.
"""
