"""Aggregations over any DataFrame."""
