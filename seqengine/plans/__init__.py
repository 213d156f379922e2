"""Pipeline specifications: thresholds, implied options, and the order of stages."""
