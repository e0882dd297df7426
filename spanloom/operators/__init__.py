"""Relational operators over interval tables."""
