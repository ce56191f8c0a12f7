"""Operators of a training-data pipeline: codecs, filters, deduplication, mixing."""
