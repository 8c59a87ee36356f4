"""Operators of a training-data pipeline: fingerprints, dedup, language, tokens, filters, packing."""
