"""Operators for preparing text corpora: filters, deduplication, redaction, packing and token output."""
