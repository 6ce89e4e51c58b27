"""Training-data operators: scoring, filtering, deduplication, sharding and tokenising of document tables.

Nothing else in the library imports this subpackage.
"""
