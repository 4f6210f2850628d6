"""Operators for preparing training data: deduplication, quality, mixing, packing, search.

Nothing else in the library imports this subpackage.  Every operator is a
function ``DataFrame -> DataFrame``; ``queries`` holds the registered queries.
"""
