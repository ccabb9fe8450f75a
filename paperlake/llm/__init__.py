"""Operators that prepare text and records for training data.  Nothing outside this package imports it."""
