"""Timeline analytics on Spark: interval, segmentation, scoring and ranking jobs keyed by video."""
