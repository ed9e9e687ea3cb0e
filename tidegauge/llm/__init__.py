"""Operators of a training-data pipeline: filtering, deduplication, tokenising, sharding.

Nothing else in the package imports this subpackage.
"""
