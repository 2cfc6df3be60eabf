"""Operators for training-data pipelines; nothing else in seqforge imports this subpackage."""
