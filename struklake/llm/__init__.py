"""Corpus preparation operators: filtering, deduplication, mixing and sharding."""
