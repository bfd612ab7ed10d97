"""Operators on training data: similar vectors, defects, look-alikes, duplicates, boilerplate, tokens, packing, toxicity."""
