"""Training-data operators: deduplication, scanning, filtering, encoding and scoring of document tables.

Nothing else in the library imports this subpackage; its queries are collected in ``folioforge.llm.queries``.
"""
