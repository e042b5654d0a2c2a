"""Operators for preparing training data: splits, duplicates, sampling, packing, mixing, quality."""
