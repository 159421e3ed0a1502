"""Whole plans: the feature pipeline, and the catalogue of queries over the driver's tables."""
