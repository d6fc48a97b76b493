"""Training-data operators: dedup, packing, mixing, scoring, filtering and formatting of text corpora."""
