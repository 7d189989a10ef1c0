"""Operators for training-data texts and vectors. Nothing outside this subpackage imports it."""
