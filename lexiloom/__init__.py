"""Text-corpus analytics on Spark: curation, deduplication, packing, post-training data and their metrics."""
