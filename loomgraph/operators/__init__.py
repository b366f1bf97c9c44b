"""Relational operators over property graphs."""
