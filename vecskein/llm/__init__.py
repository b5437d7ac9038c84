"""Training-data operators: mixing, quality, dedup, tokens, search, archives, secrets.

Nothing outside this subpackage imports it.
"""
