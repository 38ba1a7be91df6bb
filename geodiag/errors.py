"""Exceptions; each message begins with its kind."""


class GeodiagError(Exception):
    prefix = "Error"

    def __init__(self, message: str):
        super().__init__(f"{self.prefix}: {message}")


class ReadError(GeodiagError):
    prefix = "IO error"


class JsonError(GeodiagError):
    prefix = "JSON error"


class GeoJsonError(GeodiagError):
    prefix = "GeoJSON error"


class ProjectionError(GeodiagError):
    prefix = "Projection error"


class UnsupportedFormat(GeodiagError):
    prefix = "Unsupported format"


class NoAutofix(GeodiagError):
    prefix = "Rule does not support auto-fix"


class ConfigError(GeodiagError):
    prefix = "Configuration error"


class InternalError(GeodiagError):
    prefix = "Internal error"
