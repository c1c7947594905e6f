"""Operators for large text corpora: language, licences, duplicates, packing, secrets, fingerprints, shards, tokens."""
