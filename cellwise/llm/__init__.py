"""Operators for training-data pipelines on algorithms and texts. Nothing else in the library imports this subpackage."""
