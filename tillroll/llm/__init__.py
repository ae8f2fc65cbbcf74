"""Operators of a training-data pipeline: sharding, quality, packing, search, language model,
near duplicates, mixing, token counts, toxicity. Nothing else in the library imports them."""
