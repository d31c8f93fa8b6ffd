"""Training-data operators: tokens, duplicates, quality, mixing, packing."""
