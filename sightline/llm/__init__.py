"""Operators for training-data pipelines over large corpora; see each module's docstring."""
