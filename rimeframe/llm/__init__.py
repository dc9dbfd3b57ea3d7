"""Operators for preparing training data: dedup, sharding, mixing, scans, quality, tokens."""
