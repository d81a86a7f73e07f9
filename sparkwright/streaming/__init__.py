"""Batch loading of statement streams."""
