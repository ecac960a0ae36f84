"""Training-data operators: token files, near-duplicates, filters, counts and rules on text tables."""
