"""Operators of a training-data pipeline: conversation formatting, similarity
joins, mixing, deduplication, token accounting, secret scans, toxicity,
exact top-k search and byte-level BPE.

Nothing else in the library imports this subpackage.
"""
