"""Training-data operators: dedup, sharding, filtering, mixing, counting, encoding, search and scoring.

Nothing outside this subpackage imports it. Queries and their SQL twins are in ``registry``.
"""
