"""Operators that turn captured text into training data: dedup, filters, mixing, sharding, tokens.

Nothing else in the library imports this subpackage. Executors need the package on their path (``--py-files`` on a cluster).
"""
