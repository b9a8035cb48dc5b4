"""Corpus operators for large-scale training-data pipelines.  Nothing else in siftwell imports this."""
