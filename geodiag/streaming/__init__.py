"""Continuous checking of a folder."""
