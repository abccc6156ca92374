"""Training-data operators: deduplication, decontamination, scoring, mixing, token files."""
