"""Operators for training corpora: cleaning, matching, mixing, sharding and formatting of documents."""
