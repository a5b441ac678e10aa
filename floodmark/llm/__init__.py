"""Training-data operators: formatting, filtering, near duplicates, packing, sharding, scoring and storage of text."""
