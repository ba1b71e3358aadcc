"""Training-data operators: deduplication, joins, classifiers, filters and packing for document corpora."""
