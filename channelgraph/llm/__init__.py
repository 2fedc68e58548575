"""Operators that prepare training data: packing, deduplication, sharding, search, quality, mixing, archives, licences."""
