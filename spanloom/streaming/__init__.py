"""Structured Streaming twins of the interval builders and the bounded Bef join."""
