"""Operators of a training-data pipeline: near-duplicates, mixing, personal
data, licences, line dedup, packing, search, extraction and toxicity.

Nothing else in the package imports this subpackage.
"""
