"""Operators for large-scale training-data preparation.

Self-contained: nothing else in the library imports this subpackage."""
