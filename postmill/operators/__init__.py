"""Reusable DataFrame operators: checks, deduplication, skew-safe joins."""
