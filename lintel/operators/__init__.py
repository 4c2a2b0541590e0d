"""Relational operators over objects and lines."""
