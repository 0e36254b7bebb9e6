"""Operators of a training-data pipeline: scoring, deduplication, filtering, extraction, tokens.

Nothing else in the library imports this package. ``queries`` registers one query for each
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
