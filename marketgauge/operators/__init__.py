"""Operators that shuffle, aggregate, sample, train or evaluate."""
