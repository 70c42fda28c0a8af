"""Operators for training data: ranking fusion, secrets, vector search, code provenance, splitting, packing, mixing, reading level."""
