"""Operators for large text corpora: search, tokens, shards, quality, duplicates, scoring and mixing.

Nothing outside this subpackage imports it. Each operator is a module of its own; ``queries`` names the
registered queries and their SQL.
"""
