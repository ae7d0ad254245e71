"""Operators for training data; nothing else in readq imports this subpackage."""
