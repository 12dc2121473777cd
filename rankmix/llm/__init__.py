"""Operators for training-data pipelines (see README, "Training-data operators").

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
