"""Operators for training-data pipelines over documents, pages and conversations.

Nothing outside this package imports it; ``corpus_pipeline.py`` and the guarded
block of ``__spark_entry__.py`` are its only users.
"""
