"""Whole jobs put together from operators: exports and the registered queries."""
