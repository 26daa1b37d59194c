"""Training-data operators: encoding, filtering, deduplication, scoring, extraction and sharding of documents."""
