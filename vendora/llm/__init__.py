"""Operators of a training-data pipeline: decontamination, quality scoring,
near-duplicate detection, mixing, chat formatting, licence, secret and URL scans.

Each module holds one operator; ``queries`` registers them over the given
tables and holds their DuckDB counterparts.
"""
