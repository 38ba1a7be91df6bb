"""Readers of vector formats, and layers derived from plain tables."""
