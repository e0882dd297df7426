"""Reading, writing and maintaining the stored tables."""
