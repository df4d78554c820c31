"""Operators for training-data text and match groups. Nothing outside this package imports it."""
