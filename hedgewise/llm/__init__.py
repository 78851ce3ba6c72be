"""Operators for preparing training text: counting, sharding, cleaning, scoring, fingerprinting and mixing documents."""
