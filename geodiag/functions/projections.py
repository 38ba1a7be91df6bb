"""Map projections and their inverses as Column expressions, from published formulas (Snyder, USGS PP 1395; Krüger's series).

A system is a family of formulas and its constants: :func:`parameters` gives both for a code or a ``+proj`` text. Formulas
take constants as numbers, for one system, or as columns of a table with a row for each system
(:func:`with_parameters`), so that rows of many systems go through one plan. ``project`` and ``unproject`` lead from longitude and latitude
in degrees to metres (feet where the code says so) and back. NAD83 and ETRS89 count as WGS 84.
Parameters of the codes below are those of the public registries.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodiag.errors import ProjectionError
from geodiag.functions.geometry import let
from geodiag.runtime import ship

WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)
FEET = 1200.0 / 3937.0
GEOGRAPHIC = ("EPSG:4326", "OGC:CRS84", "EPSG:4269")
#: steps after which a latitude no longer changes: each divides its error by 1 / e2, about 150
STEPS = 8

CONSTANTS = ("a", "e", "lon0", "fe", "fn", "unit", "k", "n", "c", "r0", "s0", "c0", "d", "q", *(f"{x}{j}" for x in "uv" for j in range(1, 5)))
PARAMETERS = "struct<family:string," + ",".join(f"{c}:double" for c in CONSTANTS) + ">"


def _rad(c):
    return c * F.lit(math.pi / 180.0)


def _deg(c):
    return c * F.lit(180.0 / math.pi)


def _atanh(x):
    return F.log((1 + x) / (1 - x)) / 2


def _system(family: str, ellipsoid=(1.0, 0.0), **known: float) -> dict:
    """Constants that a family doesn't use are 0; lengths are divided by ``unit``."""
    a, f = ellipsoid
    return {"family": family, **dict.fromkeys(CONSTANTS, 0.0), "unit": 1.0, "a": a, "e": math.sqrt(f * (2 - f)), **{k: float(v) for k, v in known.items()}}


# --- constants of each family


def mercator(a: float) -> dict:
    return _system("merc", (a, 0.0))


def transverse_mercator(ellipsoid, lon0: float, lat0: float, k0: float, fe: float, fn: float) -> dict:
    """Krüger's series to the fourth power of the third flattening, ``u`` forward and ``v`` back; ``k`` is the scaled radius."""
    a, f = ellipsoid
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    u = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    v = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    s = math.sin(math.radians(lat0))
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    m0 = radius * (xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(u, 1)))
    return _system("tmerc", ellipsoid, lon0=lon0, fe=fe, fn=fn - k0 * m0, k=k0 * radius, **{f"u{j}": c for j, c in enumerate(u, 1)}, **{f"v{j}": c for j, c in enumerate(v, 1)})


def _m(e2, phi):
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def _q(e, s):
    return 2 * s if e == 0 else (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _eccentricity(ellipsoid):
    f = ellipsoid[1]
    return math.sqrt(f * (2 - f)), f * (2 - f)


def albers(ellipsoid, lat1, lat2, lat0, lon0, fe=0.0, fn=0.0) -> dict:
    e, e2 = _eccentricity(ellipsoid)
    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    q1, q2, q0 = (_q(e, math.sin(p)) for p in (p1, p2, p0))
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else (_m(e2, p1) ** 2 - _m(e2, p2) ** 2) / (q2 - q1)
    if n == 0:
        raise ProjectionError("parallels opposite to each other")
    c = _m(e2, p1) ** 2 + n * q1
    return _system("aea", ellipsoid, lon0=lon0, fe=fe, fn=fn, n=n, c=c, r0=ellipsoid[0] * math.sqrt(c - n * q0) / n, q=_q(e, 1.0))


def lambert_conic(ellipsoid, lat1, lat2, lat0, lon0, fe=0.0, fn=0.0, unit=1.0) -> dict:
    """``k`` is the radius of the cone's image of the equator."""
    e, e2 = _eccentricity(ellipsoid)
    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    ts = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else math.log(_m(e2, p1) / _m(e2, p2)) / math.log(ts(p1) / ts(p2))
    if n == 0:
        raise ProjectionError("parallels opposite to each other")
    k = ellipsoid[0] * _m(e2, p1) / (n * ts(p1) ** n)
    return _system("lcc", ellipsoid, lon0=lon0, fe=fe, fn=fn, unit=unit, n=n, k=k, r0=k * ts(p0) ** n)


def lambert_azimuthal(ellipsoid, lat0, lon0, fe=0.0, fn=0.0) -> dict:
    """``k`` is the authalic radius; ``s0`` and ``c0`` belong to the centre's authalic latitude."""
    e, e2 = _eccentricity(ellipsoid)
    qp, p0 = _q(e, 1.0), math.radians(lat0)
    b0, rq = math.asin(_q(e, math.sin(p0)) / qp), ellipsoid[0] * math.sqrt(qp / 2)
    d = ellipsoid[0] * _m(e2, p0) / (rq * math.cos(b0)) if abs(abs(lat0) - 90) > 1e-9 else 1.0
    return _system("laea", ellipsoid, lon0=lon0, fe=fe, fn=fn, k=rq, s0=math.sin(b0), c0=math.cos(b0), d=d, q=qp)


def cylindrical_equal_area(ellipsoid, lat_ts, lon0) -> dict:
    e, e2 = _eccentricity(ellipsoid)
    return _system("cea", ellipsoid, lon0=lon0, k=_m(e2, math.radians(lat_ts)), q=_q(e, 1.0))


def mollweide(a: float, lon0: float = 0.0) -> dict:
    return _system("moll", (a, 0.0), lon0=lon0)


def robinson(a: float, lon0: float = 0.0) -> dict:
    return _system("robin", (a, 0.0), lon0=lon0)


# --- formulas: p holds constants, as numbers or columns


class _Pair(tuple):
    """x and y of a struct, and the struct ``whole``, so that it needn't be computed for each."""

    def __new__(cls, out: Column):
        pair = super().__new__(cls, (out["x"], out["y"]))
        pair.whole = out
        return pair


def _q_col(e, s):
    """Snyder's q of a sine of latitude; ``e`` may be 0."""
    if not isinstance(e, Column):
        return 2 * s if e == 0 else (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return F.when(e == 0, 2 * s).otherwise((1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e)))


def _of_q(p, q):
    """Latitude of q: the authalic latitude's series to the sixth power of e, and a Newton step away from the poles."""
    e = p["e"]
    e2 = e * e
    e4, e6 = e2 * e2, e2 * e2 * e2

    def series(b):
        phi = b + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + (761 * e6 / 45360) * F.sin(6 * b)
        step = lambda f: let(F.sin(f), lambda s: f + F.when(F.cos(f) > 1e-6, (1 - e2 * s * s) * (1 - e2 * s * s) / (2 * F.cos(f) * (1 - e2)) * (q - _q_col(e, s))).otherwise(0.0))
        return let(phi, step)

    return let(F.asin(F.greatest(F.least(q / p["q"], F.lit(1.0)), F.lit(-1.0))), series)


def _of_isometric(psi, e):
    """Latitude of an isometric latitude by a fixed number of steps."""
    near = lambda s: psi + e * _atanh(e * s)
    s = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.tanh(psi), lambda s, _: F.tanh(near(s)))
    return let(s, lambda s: F.atan(F.sinh(near(s))))


def _merc(p, lon, lat):
    return _rad(lon) * p["a"], F.log(F.tan(F.lit(math.pi / 4) + _rad(lat) / 2)) * p["a"]


def _merc_back(p, x, y):
    return _deg(x / p["a"]), _deg(2 * F.atan(F.exp(y / p["a"])) - math.pi / 2)


def _tmerc(p, lon, lat):
    def series(v):
        x, y = v["eta"], v["xi"]
        for j in range(1, 5):
            x = x + p[f"u{j}"] * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            y = y + p[f"u{j}"] * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        return F.struct((x * p["k"] + p["fe"]).alias("x"), (y * p["k"] + p["fn"]).alias("y"))

    angles = lambda v: let(F.struct(F.atan2(v["t"], F.cos(v["lam"])).alias("xi"), _atanh(F.sin(v["lam"]) / F.sqrt(1 + v["t"] * v["t"])).alias("eta")), series)
    out = let(F.sin(_rad(lat)), lambda s: let(F.struct(_rad(lon - p["lon0"]).alias("lam"), F.sinh(_atanh(s) - p["e"] * _atanh(p["e"] * s)).alias("t")), angles))
    return _Pair(out)


def _tmerc_back(p, x, y):
    def series(v):
        xi, eta = v["xi"], v["eta"]
        for j in range(1, 5):
            xi = xi - p[f"v{j}"] * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta - p[f"v{j}"] * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return let(F.struct(xi.alias("xi"), eta.alias("eta")), angles)

    def angles(v):
        psi = F.asinh(F.sin(v["xi"]) / F.sqrt(F.sinh(v["eta"]) * F.sinh(v["eta"]) + F.cos(v["xi"]) * F.cos(v["xi"])))
        return F.struct((_deg(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"]))) + p["lon0"]).alias("x"), _deg(let(psi, lambda s: _of_isometric(s, p["e"]))).alias("y"))

    out = let(F.struct(((y - p["fn"]) / p["k"]).alias("xi"), ((x - p["fe"]) / p["k"]).alias("eta")), series)
    return _Pair(out)


def _aea(p, lon, lat):
    r = p["a"] * F.sqrt(p["c"] - p["n"] * _q_col(p["e"], F.sin(_rad(lat)))) / p["n"]
    t = p["n"] * _rad(lon - p["lon0"])
    return r * F.sin(t) + p["fe"], p["r0"] - r * F.cos(t) + p["fn"]


def _cone(p, x, y):
    """Radius, with the sign of n, and longitude in degrees."""
    dx, dy, sign = x - p["fe"], p["r0"] - (y - p["fn"]), F.signum(F.lit(p["n"]))
    return sign * F.sqrt(dx * dx + dy * dy), _deg(F.atan2(sign * dx, sign * dy) / p["n"]) + p["lon0"]


def _aea_back(p, x, y):
    r, lon = _cone(p, x, y)
    return lon, _deg(let((p["c"] - r * r * p["n"] * p["n"] / (p["a"] * p["a"])) / p["n"], lambda q: _of_q(p, q)))


def _lcc(p, lon, lat):
    s, e = F.sin(_rad(lat)), p["e"]
    t = F.tan(F.lit(math.pi / 4) - _rad(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e) / 2)
    r, th = p["k"] * F.pow(t, F.lit(p["n"])), p["n"] * _rad(lon - p["lon0"])
    return (r * F.sin(th) + p["fe"]) / p["unit"], (p["r0"] - r * F.cos(th) + p["fn"]) / p["unit"]


def _lcc_back(p, x, y):
    r, lon = _cone(p, x * p["unit"], y * p["unit"])
    return lon, _deg(let(-F.log(r / p["k"]) / p["n"], lambda psi: _of_isometric(psi, p["e"])))


def _laea(p, lon, lat):
    dl = _rad(lon - p["lon0"])

    def place(sb):
        cb = F.sqrt(F.greatest(1 - sb * sb, F.lit(0.0)))
        b = p["k"] * F.sqrt(2 / (1 + p["s0"] * sb + p["c0"] * cb * F.cos(dl)))
        return F.struct((b * p["d"] * cb * F.sin(dl) + p["fe"]).alias("x"), ((b / p["d"]) * (p["c0"] * sb - p["s0"] * cb * F.cos(dl)) + p["fn"]).alias("y"))

    out = let(_q_col(p["e"], F.sin(_rad(lat))) / p["q"], place)
    return _Pair(out)


def _laea_back(p, x, y):
    def angles(v):
        r = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        return let(F.struct(v["x"].alias("x"), v["y"].alias("y"), r.alias("r"), (2 * F.asin(F.least(r / (2 * p["k"]), F.lit(1.0)))).alias("c")), place)

    def place(v):
        sb = F.when(v["r"] > 0, F.cos(v["c"]) * p["s0"] + v["y"] * F.sin(v["c"]) * p["c0"] / v["r"]).otherwise(p["s0"])
        lam = F.when(v["r"] > 0, F.atan2(v["x"] * F.sin(v["c"]), v["r"] * p["c0"] * F.cos(v["c"]) - v["y"] * p["s0"] * F.sin(v["c"]))).otherwise(0.0)
        return F.struct((_deg(lam) + p["lon0"]).alias("x"), _deg(let(sb * p["q"], lambda q: _of_q(p, q))).alias("y"))

    out = let(F.struct(((x - p["fe"]) / p["d"]).alias("x"), ((y - p["fn"]) * p["d"]).alias("y")), angles)
    return _Pair(out)


def _cea(p, lon, lat):
    return p["a"] * p["k"] * _rad(lon - p["lon0"]), p["a"] * _q_col(p["e"], F.sin(_rad(lat))) / (2 * p["k"])


def _cea_back(p, x, y):
    return _deg(x / (p["a"] * p["k"])) + p["lon0"], _deg(let(2 * y * p["k"] / p["a"], lambda q: _of_q(p, q)))


def _moll(p, lon, lat):
    """The parametric angle by Newton steps: enough for the poles, where each halves the error; up to 85 degrees ten reach the last bit."""
    phi = _rad(lat)
    target = math.pi * F.sin(phi)
    step = lambda u, _: u - F.when(1 + F.cos(u) > 1e-12, (u + F.sin(u) - target) / (1 + F.cos(u))).otherwise(0.0)
    t = F.aggregate(F.sequence(F.lit(1), F.when(F.abs(lat) <= 85, 12).otherwise(40)), phi, step) / 2
    return p["a"] * (2 * math.sqrt(2) / math.pi) * _rad(lon - p["lon0"]) * F.cos(t), p["a"] * math.sqrt(2) * F.sin(t)


def _moll_back(p, x, y):
    t = F.asin(F.greatest(F.least(y / (p["a"] * math.sqrt(2)), F.lit(1.0)), F.lit(-1.0)))
    lon = let(t, lambda t: F.when(F.cos(t) > 1e-12, math.pi * x / (2 * math.sqrt(2) * p["a"] * F.cos(t))).otherwise(0.0))
    return _deg(lon) + p["lon0"], _deg(let(t, lambda t: F.asin(F.greatest(F.least((2 * t + F.sin(2 * t)) / math.pi, F.lit(1.0)), F.lit(-1.0)))))


# fixed values: Robinson's table, length of parallels and distance from the equator every 5 degrees
_ROBINSON = (
    (1.0, 0.0), (0.9986, 0.062), (0.9954, 0.124), (0.99, 0.186), (0.9822, 0.248), (0.973, 0.31), (0.96, 0.372), (0.9427, 0.434), (0.9216, 0.4958), (0.8962, 0.5571),
    (0.8679, 0.6176), (0.835, 0.6769), (0.7986, 0.7346), (0.7597, 0.7903), (0.7186, 0.8435), (0.6732, 0.8936), (0.6213, 0.9394), (0.5722, 0.9761), (0.5322, 1.0),
)




def _column(name: str) -> Column:
    return F.array(*(F.lit(r["xy".index(name)]) for r in _ROBINSON))


def _between(i, p, name):
    """Second differences between the table's rows, ``p`` steps from row ``i``."""
    near = lambda r: r[1] + p * (r[2] - r[0]) / 2 + p * p * (r[2] - 2 * r[1] + r[0]) / 2
    return let(F.slice(_column(name), i, 3), near)


def _robin(p, lon, lat):
    z = F.least(F.abs(lat), F.lit(90.0)) / 5
    i = F.greatest(F.least(F.floor(z), F.lit(17)), F.lit(1)).cast("int")
    return p["a"] * 0.8487 * _between(i, z - i, "x") * _rad(lon - p["lon0"]), p["a"] * 1.3523 * _between(i, z - i, "y") * F.signum(lat)


def _robin_back(p, x, y):
    """The row below a distance from the equator, then the root of the quadratic through three rows."""

    def root(h):
        i = F.greatest(F.least(F.size(F.filter(_column("y"), lambda y: y <= h)) - 1, F.lit(17)), F.lit(1))

        def solve(i):
            y0, y1, y2 = (_column("y")[i + k] for k in (-1, 0, 1))
            a, b, c = (y2 - 2 * y1 + y0) / 2, (y2 - y0) / 2, y1 - h
            step = -2 * c / (b + F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0))))
            return F.struct(i.alias("i"), step.alias("p"))

        return let(i, solve)

    found = let(F.abs(y) / (p["a"] * 1.3523), root)
    out = let(found, lambda v: F.struct((_deg(x / (p["a"] * 0.8487 * _between(v["i"], v["p"], "x"))) + p["lon0"]).alias("x"), (5 * (v["i"] + v["p"]) * F.signum(y)).alias("y")))
    return _Pair(out)


def _same(p, x, y):
    return x, y


FORWARD = {"geographic": _same, "merc": _merc, "tmerc": _tmerc, "aea": _aea, "lcc": _lcc, "laea": _laea, "cea": _cea, "moll": _moll, "robin": _robin}
BACK = {"geographic": _same, "merc": _merc_back, "tmerc": _tmerc_back, "aea": _aea_back, "lcc": _lcc_back, "laea": _laea_back, "cea": _cea_back, "moll": _moll_back, "robin": _robin_back}


def _proj_string(text: str) -> dict:
    """The projections that recommendations use, written as ``+proj=...``."""
    p = dict(x.lstrip("+").partition("=")[::2] for x in text.split() if x.startswith("+"))
    num = lambda k, d=0.0: float(p.get(k, d))
    ell = GRS80 if p.get("datum") == "NAD83" or p.get("ellps") == "GRS80" else WGS84
    kind = p.get("proj")
    if kind in ("longlat", "latlong"):
        return _system("geographic", ell)
    if kind == "aea":
        return albers(ell, num("lat_1"), num("lat_2"), num("lat_0"), num("lon_0"), num("x_0"), num("y_0"))
    if kind == "lcc":
        return lambert_conic(ell, num("lat_1"), num("lat_2", num("lat_1")), num("lat_0"), num("lon_0"), num("x_0"), num("y_0"))
    if kind == "tmerc":
        return transverse_mercator(ell, num("lon_0"), num("lat_0"), num("k", num("k_0", 1.0)), num("x_0"), num("y_0"))
    if kind == "utm":
        return transverse_mercator(ell, 6 * num("zone") - 183, 0.0, 0.9996, 500000.0, 1e7 if "south" in p else 0.0)
    if kind == "laea":
        return lambert_azimuthal(ell, num("lat_0"), num("lon_0"), num("x_0"), num("y_0"))
    if kind == "cea":
        return cylindrical_equal_area(ell, num("lat_ts"), num("lon_0"))
    if kind == "moll":
        return mollweide(6378137.0, num("lon_0"))
    if kind == "robin":
        return robinson(6378137.0, num("lon_0"))
    raise ProjectionError(f"Failed to create projection {text}: unknown projection {kind}")


# fixed values: parameters of the public registries
CODES = {
    3857: lambda: mercator(6378137.0),
    5070: lambda: albers(GRS80, 29.5, 45.5, 23.0, -96.0),
    102003: lambda: albers(GRS80, 29.5, 45.5, 37.5, -96.0),
    3338: lambda: albers(GRS80, 55.0, 65.0, 50.0, -154.0),
    3089: lambda: lambert_conic(GRS80, 37 + 5 / 60, 38 + 40 / 60, 36 + 20 / 60, -85.75, 1500000.0, 1000000.0, FEET),
    2205: lambda: lambert_conic(GRS80, 37.9666666666667, 38.9666666666667, 37.5, -84.25, 500000.0, 0.0),
    2278: lambda: lambert_conic(GRS80, 30 + 17 / 60, 28 + 23 / 60, 27 + 50 / 60, -99.0, 600000.0, 4000000.0, FEET),
    3035: lambda: lambert_azimuthal(GRS80, 52.0, 10.0, 4321000.0, 3210000.0),
    2163: lambda: lambert_azimuthal((6370997.0, 0.0), 45.0, -100.0),
    6933: lambda: cylindrical_equal_area(WGS84, 30.0, 0.0),
    3826: lambda: transverse_mercator(GRS80, 121.0, 0.0, 0.9999, 250000.0, 0.0),
    54009: lambda: mollweide(6378137.0),
    54030: lambda: robinson(6378137.0),
}


def parameters(crs: str) -> dict:
    """Family and constants of a system; ProjectionError if it isn't known."""
    if crs in GEOGRAPHIC:
        return _system("geographic", WGS84)
    if crs.startswith("+proj"):
        return _proj_string(crs)
    m = re.fullmatch(r"(?i)(EPSG|ESRI):(\d+)", crs.strip())
    code = int(m[2]) if m else 0
    if not m:
        raise ProjectionError(f"Failed to create projection {crs}: not a known code")
    for first, ell, north in ((32600, WGS84, True), (32700, WGS84, False), (26900, GRS80, True)):
        if first < code <= first + (60 if first != 26900 else 23):
            return transverse_mercator(ell, 6 * (code - first) - 183, 0.0, 0.9996, 500000.0, 0.0 if north else 1e7)
    if code not in CODES:
        raise ProjectionError(f"Failed to create projection {crs}: code not supported")
    return CODES[code]()


def with_parameters(systems: DataFrame, crs: str = "crs", name: str = "projection") -> DataFrame:
    """Add the parameters of each row's system; null where it isn't known. For tables of systems: a row for each, not for each feature."""
    ship(systems.sparkSession)

    @F.udf(PARAMETERS)
    def of(text):
        try:
            return None if text is None else parameters(text)
        except ProjectionError:
            return None

    return systems.withColumn(name, of(F.col(crs)))


def _xy(r: tuple[Column, Column]) -> Column:
    """``struct<x,y>`` of what a formula gives."""
    return r.whole if isinstance(r, _Pair) else F.struct(r[0].alias("x"), r[1].alias("y"))


def _finite(r: Column) -> Column:
    """A ``struct<x,y>``, computed once; null where it isn't finite."""
    inside = lambda c: F.abs(c) < float("inf")  # noqa: E731, nan is above all numbers
    return let(r, lambda v: F.when(inside(v["x"]) & inside(v["y"]), v))


def _by_family(formulas: dict, p: Column, u: Column, v: Column) -> Column:
    """``struct<x,y>``, finite or not."""
    xy = lambda f: _xy(f(p, u, v))
    out = None
    for family, f in formulas.items():
        out = F.when(p["family"] == family, xy(f)) if out is None else out.when(p["family"] == family, xy(f))
    return out


def place(crs: str | Column, lon: Column, lat: Column) -> Column:
    """As :func:`project`, with results that aren't finite."""
    if isinstance(crs, Column):
        return _by_family(FORWARD, crs, lon, lat)
    p = parameters(crs)
    return _xy(FORWARD[p["family"]](p, lon, lat))


def project(crs: str | Column, lon: Column, lat: Column) -> Column:
    """``struct<x,y>`` of a system, or of a column of parameters; null where the result isn't finite."""
    if isinstance(crs, Column):
        return _finite(_by_family(FORWARD, crs, lon, lat))
    p = parameters(crs)
    return _finite(_xy(FORWARD[p["family"]](p, lon, lat)))


def unproject(crs: str | Column, x: Column, y: Column) -> Column:
    """``struct<x,y>`` with longitude and latitude in degrees, the inverse of :func:`project`; null where there is none."""
    if isinstance(crs, Column):
        return _finite(_by_family(BACK, crs, x, y))
    p = parameters(crs)
    return _finite(_xy(BACK[p["family"]](p, x, y)))
