"""Training-data operators: deduplication, tokenisation, packing, scans, search."""
