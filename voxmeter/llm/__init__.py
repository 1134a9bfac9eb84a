"""Training-data operators: decontamination, deduplication, filtering, extraction,
surrogates, scoring, packing and language identification."""
