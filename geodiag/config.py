"""Settings, their defaults, and the cascade defaults < file < environment < arguments."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace

from geodiag.errors import ConfigError

FILE = ".geodiag.yml"


@dataclass(frozen=True)
class XrayConfig:
    max_samples: int = 1000
    top_recommendations: int = 5
    #: what candidates are ranked by: area, distance, shape or balanced
    optimize_for: str = "area"
    #: systems that are always evaluated, and never recommended
    include_crs: tuple[str, ...] = ()
    exclude_crs: tuple[str, ...] = ()


@dataclass(frozen=True)
class CheckConfig:
    max_distortion_pct: float = 10.0
    topology_gap_tolerance: float = 0.001
    disabled_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScoreConfig:
    projection_weight: float = 0.25
    data_integrity_weight: float = 0.30
    accessibility_weight: float = 0.20
    cloud_readiness_weight: float = 0.20
    classification_weight: float = 0.05


@dataclass(frozen=True)
class OutputConfig:
    open_browser: bool = True
    terminal_only: bool = False


@dataclass(frozen=True)
class Config:
    xray: XrayConfig = field(default_factory=XrayConfig)
    check: CheckConfig = field(default_factory=CheckConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    #: "compat" keeps the established formulas, "exact" the true ones
    mode: str = "compat"

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """Settings of a YAML file; unknown keys are ignored, missing ones keep their default."""
        if path is None:
            return cls()
        with open(path, encoding="utf-8") as f:
            return cls().merged(parse_yaml(f.read()))

    @classmethod
    def discover(cls) -> Config:
        """The file in the working directory if there is one, then ``GEODIAG_<SECTION>_<KEY>`` variables."""
        out = cls.load(FILE) if os.path.exists(FILE) else cls()
        env: dict = {}
        for section in ("xray", "check", "score", "output"):
            for f in fields(getattr(out, section)):
                if (v := os.environ.get(f"GEODIAG_{section}_{f.name}".upper())) is not None:
                    env.setdefault(section, {})[f.name] = _scalar(v)
        return out.merged(env)

    def merged(self, values: dict) -> Config:
        """A copy with the given sections' values."""
        if not isinstance(values, dict):
            raise ConfigError("Failed to parse config: sections are expected")
        out = self
        for section in ("xray", "check", "score", "output"):
            own = getattr(out, section)
            given = values.get(section) or {}
            if not isinstance(given, dict):
                raise ConfigError(f"Failed to parse config: {section} must have keys")
            new = {}
            for f in fields(own):
                if f.name in given:
                    new[f.name] = _typed(given[f.name], getattr(own, f.name), f"{section}.{f.name}")
            out = replace(out, **{section: replace(own, **new)})
        return out

    def to_dict(self) -> dict:
        return asdict(self)


def _typed(value, like, name: str):
    try:
        if isinstance(like, bool):
            if not isinstance(value, bool):
                raise ValueError
            return value
        if isinstance(like, tuple):
            return tuple(map(str, value if isinstance(value, (list, tuple)) else str(value).split(",")))
        if isinstance(like, int) and not float(value).is_integer():
            raise ValueError
        return type(like)(value)
    except (TypeError, ValueError):
        raise ConfigError(f"Failed to parse config: bad value for {name}: {value!r}") from None


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s in ("true", "false"):
        return s == "true"
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def parse_yaml(text: str) -> dict:
    """The part of YAML that settings use: sections of scalars and lists."""
    out: dict = {}
    section, key = None, None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- ") and section is not None and key:
            if not isinstance(out[section].get(key), list):
                out[section][key] = []
            out[section][key].append(_scalar(body[2:]))
            continue
        name, colon, value = body.partition(":")
        if not colon:
            raise ConfigError(f"Failed to parse config: {body!r}")
        if indent == 0:
            section, key = name, None
            out[section] = {} if not value.strip() else _scalar(value)
        elif isinstance(out.get(section), dict):
            key = name
            out[section][key] = _scalar(value) if value.strip() else []
        else:
            raise ConfigError(f"Failed to parse config: {body!r}")
    return out


TEMPLATE = """# geodiag configuration
xray:
  max_samples: 1000
  top_recommendations: 5

check:
  max_distortion_pct: 10.0
  topology_gap_tolerance: 0.001
  disabled_rules: []

score:
  projection_weight: 0.25
  data_integrity_weight: 0.30
  accessibility_weight: 0.20
  cloud_readiness_weight: 0.20
  classification_weight: 0.05

output:
  open_browser: true
  terminal_only: false
"""


def init(force: bool = False, path: str = FILE) -> str:
    """Write the template; refuses to overwrite without ``force``."""
    if os.path.exists(path) and not force:
        raise ConfigError(f"{path} already exists. Use --force to overwrite.")
    with open(path, "w", encoding="utf-8") as f:
        f.write(TEMPLATE)
    return path
