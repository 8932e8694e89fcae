"""Streaming ingestion into encrypted tables."""
