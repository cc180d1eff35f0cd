"""Operators for preparing training text: tokenizing, scoring, deduplicating, screening and sharding."""
