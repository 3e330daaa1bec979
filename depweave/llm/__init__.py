"""Operators for preparing training data at scale; one module for each, queries in ``registry``."""
