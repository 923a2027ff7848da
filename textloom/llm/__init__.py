"""Training-data operators: dedup, sharding, PII, mixing, quality, LM scoring, packing, media."""
