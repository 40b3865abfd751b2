"""Readers of price tables and landed files."""
