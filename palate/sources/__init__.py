"""Reading, normalising and merging tables."""
