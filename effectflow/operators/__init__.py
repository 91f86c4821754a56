"""Relational operators over program facts, usable on any tables."""
