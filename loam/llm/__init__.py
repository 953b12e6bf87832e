"""Training-data operators: deduplication, packing, classification, archives and tokenisation.

Nothing else in the library imports this subpackage.
"""
