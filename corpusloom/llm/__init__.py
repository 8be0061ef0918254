"""Training-data operators: sharding, tokenising, mixing, scoring, near duplicates, personal data."""
