"""The five anomaly detectors, their common score and summaries."""
