"""Synthetic snapshots and the registry of queries over them."""
