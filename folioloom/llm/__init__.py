"""Training-data operators: dedup, filters, mixing, packing, sharding and token output.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
