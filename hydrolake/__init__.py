"""Flood early-warning analytics on Spark: series, tides, risk, space, training data."""
