"""Training-data operators for corpora of any size: scoring, near-duplicate search, packing, sharding.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""
