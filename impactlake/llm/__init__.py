"""Training-data operators: corpus quality, dedup, packing, tokens, text extraction and search."""
