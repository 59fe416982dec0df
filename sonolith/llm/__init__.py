"""Training-data operators: scoring, filtering, dedup, sharding and token output.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
