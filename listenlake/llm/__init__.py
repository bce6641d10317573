"""Operators a large training-data pipeline needs, each by one stated method."""
