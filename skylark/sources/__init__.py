"""Readers and writers of snapshot tables."""
