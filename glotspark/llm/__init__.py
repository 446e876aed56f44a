"""Operators for training-data corpora. Nothing else in glotspark imports this subpackage."""
