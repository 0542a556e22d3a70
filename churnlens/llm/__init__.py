"""Training-data operators: dedup, tokenising, sharding, decontamination, filters, extraction, search, LM scoring.

Nothing else in the library imports this subpackage.
"""
