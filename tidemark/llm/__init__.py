"""Training-data operators: dedup, scoring, filtering, mixing, tokenising and archiving of documents."""
