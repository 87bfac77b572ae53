"""Training-data operators: dedup, scoring, mixing, packing and token accounting over document tables."""
