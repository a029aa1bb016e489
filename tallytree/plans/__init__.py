"""Whole plans: reconciliation of wide frames, demo panels, plot-ready frames."""
