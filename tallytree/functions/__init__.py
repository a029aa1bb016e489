"""Column functions: aggregates by name, metrics, quantile levels and output names."""
