"""Operators of a training-data pipeline: joins, filters, scans, packing and search over documents."""
