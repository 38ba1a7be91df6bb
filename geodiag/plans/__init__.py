"""Whole runs over a dataset, and the registered queries."""
