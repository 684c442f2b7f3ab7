"""Operators for building training data from texts and records."""
