"""geodiag: a PySpark-native diagnostics engine for geospatial vector data."""

__version__ = "0.1.0"
