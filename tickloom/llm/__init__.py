"""Operators for preparing training text: deduplication, packing, mixing, scans and classifiers over DataFrames.

Nothing else in the library imports this package. `queries.QUERIES` lists the registered queries.
"""
