"""Training-data operators: search, tokens, language, deduplication, packing, quality and toxicity."""
