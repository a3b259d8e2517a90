"""Operators for preparing training text: privacy, deduplication, language, toxicity, leaks, licences, pieces."""
