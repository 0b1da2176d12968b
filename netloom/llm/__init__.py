"""Operators for large training-text corpora; nothing else in the package imports this subpackage."""
