"""Whole flows: the unified feature table and the modelling experiments."""
