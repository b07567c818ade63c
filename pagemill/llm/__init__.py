"""Training-data operators: filters, near-duplicates, mixing, packing, scans and counts."""
