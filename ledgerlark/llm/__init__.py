"""Operators for preparing text corpora: redaction, formatting, deduplication, scoring, mixing and sharding.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries when it is present.
"""
