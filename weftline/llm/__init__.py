"""Training-data operators: filtering, formatting, fingerprints, packing, search.

Nothing outside this subpackage imports it.
"""
