"""Encrypted tables."""
