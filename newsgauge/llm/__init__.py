"""Operators of a training-data pipeline: fingerprints, joins, filters, packing and token files."""
