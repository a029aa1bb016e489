"""Aggregation, reconciliation, intervals and evaluation as DataFrame operators."""
