"""Relational building blocks: counts, weights, draws, pairing, unions."""
