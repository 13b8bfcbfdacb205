"""Training-data operators: formatting, deduplication, filtering, packing and token output."""
