"""Training-data preparation operators: deduplication, decontamination, filtering, mixing, sharding, formatting."""
