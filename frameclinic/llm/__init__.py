"""Operators for training-data pipelines: deduplication, decontamination, extraction, labelling, packing, formatting.

Nothing outside this folder imports it; ``queries.py`` and ``oracle.py`` hold its registered queries.
"""
