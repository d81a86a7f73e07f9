"""Expressions and aggregates."""
