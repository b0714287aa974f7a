"""Relational operators over assets."""
