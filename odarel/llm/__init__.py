"""Operators for preparing training corpora: mixing, counting, filtering, deduplication, sharding."""
