"""Coherent hierarchical aggregation and forecast reconciliation on Spark."""
