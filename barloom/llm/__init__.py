"""Training-data operators: deduplication, tokenization, classifiers, decontamination, sharding, token files."""
