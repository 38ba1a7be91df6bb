"""Column functions: geometry, projections, text."""
