"""Operators for training-data pipelines: texts, tokens, near copies, packing, nearest neighbours."""
