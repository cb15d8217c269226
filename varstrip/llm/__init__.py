"""Operators of a training-data pipeline: duplicates, leaks, secrets, licences, quality, tokens."""
