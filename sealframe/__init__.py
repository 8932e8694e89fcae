"""Sealframe: search and analytics over tables that are encrypted at rest, and corpus preparation, on Spark."""
