"""Training-data operators: formatting, extraction, deduplication, search, quality, mixing, packing.

Nothing else in the library imports this subpackage. Operators take and return DataFrames; the
queries registered for them, with their SQL twins, are in ``keelson.llm.catalog``.
"""
