"""Training-data operators: mixing, filtering, deduplication, archives, counting, sharding."""
