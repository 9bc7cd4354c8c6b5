"""World and page coordinates, map projections, and latitude/longitude text.

Projections are closed formulas from degrees to metres as Column arithmetic, on
a sphere (UTM: on the WGS 84 ellipsoid) or, where projection text names one, on
an ellipsoid (module ``ellipsoid``); no datum shift is applied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.ellipsoid import NAMES as ELLIPSOIDAL
from terrane.functions.ellipsoid import Ellipsoid

#: Fixed value: radius in metres on which projected coordinates are based.
RADIUS = 6378137.0


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


@dataclass(frozen=True)
class Window:
    """Affine map from a world rectangle to a page rectangle (millimetres)."""

    sx: float
    sy: float
    tx: float
    ty: float

    @classmethod
    def fit(cls, world: tuple[float, float, float, float], page: tuple[float, float, float, float], distortion: bool = False) -> Window:
        """world and page: xmin, ymin, xmax, ymax.  Without distortion the world
        range grows around its centre until both scales agree."""
        x0, y0, x1, y1 = world
        px0, py0, px1, py1 = page
        if x1 <= x0 or y1 <= y0 or px1 <= px0 or py1 <= py0:
            raise ValueError("a range is empty")
        sx, sy = (px1 - px0) / (x1 - x0), (py1 - py0) / (y1 - y0)
        if not distortion:
            scale = min(sx, sy)
            cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
            x0, y0 = cx - (px1 - px0) / scale / 2, cy - (py1 - py0) / scale / 2
            sx = sy = scale
        return cls(sx, sy, px0 - x0 * sx, py0 - y0 * sy)

    def to_page(self, x, y) -> tuple[Column, Column]:
        return _col(x) * self.sx + self.tx, _col(y) * self.sy + self.ty

    def to_world(self, x, y) -> tuple[Column, Column]:
        return (_col(x) - self.tx) / self.sx, (_col(y) - self.ty) / self.sy

    #: Millimetres in a world unit.
    UNITS = {"metres": 1000.0, "feet": 304.8, "degrees": 110_000_000.0}

    def world_scale(self, unit: str = "metres") -> float:
        """The n of a map scale 1:n."""
        return self.UNITS[unit] / self.sx


def _theta(lat: Column) -> Column:
    """Auxiliary angle of the Mollweide projection, by fixed Newton steps."""
    step = lambda t, _: t - (2 * t + F.sin(2 * t) - math.pi * F.sin(lat)) / F.greatest(2 + 2 * F.cos(2 * t), F.lit(1e-9))
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(12)), lat, step)
    return F.when(F.abs(F.abs(lat) - math.pi / 2) < 1e-9, lat).otherwise(theta)


#: Axis and flattening of the WGS 84 ellipsoid; scale and false easting and northing of UTM.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_MERIDIAN = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the third order: from the sphere, back to it, and from conformal to geodetic latitude.
_TO_GRID = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_FROM_GRID = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_GEODETIC = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def _series(terms: tuple[float, ...], xi: Column, eta: Column) -> tuple[Column, Column]:
    """Corrections to both coordinates on the sphere's transverse cylinder."""
    north = sum(k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(terms, 1))
    east = sum(k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(terms, 1))
    return north, east


def _utm_origin(zone: int, south: bool) -> tuple[float, float]:
    if not 1 <= zone <= 60:
        raise ValueError(f"no such UTM zone: {zone}")
    return zone * 6.0 - 183.0, UTM_SOUTH if south else 0.0


def utm_forward(lon, lat, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of degrees; NULL a quarter turn or more off the zone."""
    lon0, north0 = _utm_origin(zone, south)
    lam, sine = F.radians(_col(lon) - lon0), F.sin(F.radians(_col(lat)))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = _series(_TO_GRID, xi, eta)
    ok, k = F.cos(lam) > 1e-9, UTM_SCALE * _MERIDIAN
    return F.when(ok, UTM_EAST + k * (eta + east)), F.when(ok, north0 + k * (xi + north))


def utm_inverse(x, y, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Degrees of easting and northing."""
    lon0, north0 = _utm_origin(zone, south)
    k = UTM_SCALE * _MERIDIAN
    xi, eta = (_col(y) - north0) / k, (_col(x) - UTM_EAST) / k
    north, east = _series(_FROM_GRID, xi, eta)
    xi, eta = xi - north, eta - east
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_GEODETIC, 1))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + lon0, F.degrees(lat)


def definition(text: str) -> tuple[str, dict]:
    """Name and parameters of a projection: a plain name, or ``+proj=`` text.

    Text may hold lon_0, lat_0, lat_1, lat_2, lat_ts, zone, south, x_0, y_0,
    k_0 (or k), R (or a), and units=m; type and no_defs are read and change
    nothing.  datum, ellps, a with b, rf or f name an ellipsoid: merc, lcc, aea,
    cea, tmerc and utm are computed on it, the others on a sphere of its axis.
    Anything else is an error.
    """
    if "proj=" not in text:
        return text, {}
    given = dict(word.lstrip("+").partition("=")[::2] for word in text.split())
    name = given.pop("proj")
    for ignored in ("type", "no_defs"):
        given.pop(ignored, None)
    shape = None if "R" in given else Ellipsoid.of(given)
    if given.pop("units", "m") != "m":
        raise ValueError(f"only metres are known: {text}")
    par: dict = {"south": True} if given.pop("south", None) is not None else {}
    if "zone" in given:
        par["zone"] = int(given.pop("zone"))
    rename = {"lon_0": "lon0", "k": "k_0", "a": "R"}
    for key, value in given.items():
        if key not in ("lon_0", "lat_0", "lat_1", "lat_2", "lat_ts", "x_0", "y_0", "k_0", "k", "R", "a"):
            raise ValueError(f"unknown parameter {key}: {text}")
        par[rename.get(key, key)] = float(value)
    if name in ("longlat", "lonlat", "latlon"):
        name = "latlong"
    if name in ("lcc", "aea"):
        par.setdefault("lat_0", 0.0)
        par.setdefault("lat_2", par.get("lat_1"))
    if shape and name in (*ELLIPSOIDAL, "utm"):
        if name == "utm":
            lon0, north0 = _utm_origin(par.pop("zone"), par.pop("south", False))
            name, par = "tmerc", {"lon0": lon0, "k_0": UTM_SCALE, "x_0": UTM_EAST, "y_0": north0}
        par["shape"] = shape
    elif shape:
        par.setdefault("R", shape.axis)
    return name, par


def _frame(par: dict) -> tuple[float, float, float, dict]:
    """Scale, false easting and northing, and the other parameters."""
    rest = {k: v for k, v in par.items() if k not in ("x_0", "y_0", "k_0", "R")}
    radius = 1.0 if "shape" in par else par.get("R", RADIUS) / RADIUS
    return par.get("k_0", 1.0) * radius, par.get("x_0", 0.0), par.get("y_0", 0.0), rest


def forward(name: str, lon, lat, lon0: float = 0.0, **par) -> tuple[Column, Column]:
    """Projected x, y in metres of degrees; ``shape``: an Ellipsoid in place of the sphere."""
    if "shape" in par:
        return par.pop("shape").forward(name, _col(lon), _col(lat), lon0, **par)
    lam, phi, r = F.radians(_col(lon) - lon0), F.radians(_col(lat)), RADIUS
    if name == "latlong":
        return _col(lon), _col(lat)
    if name == "merc":
        ok = F.abs(phi) < math.pi / 2
        return F.when(ok, r * lam), F.when(ok, r * F.log(F.tan(math.pi / 4 + phi / 2)))
    if name == "sinu":
        return r * lam * F.cos(phi), r * phi
    if name == "eqc":
        return r * lam * math.cos(math.radians(par.get("lat_ts", 0.0))), r * phi
    if name == "cea":
        k = math.cos(math.radians(par.get("lat_ts", 0.0)))
        return r * lam * k, r * F.sin(phi) / k
    if name == "moll":
        t = _theta(phi)
        return r * (2 * math.sqrt(2) / math.pi) * lam * F.cos(t), r * math.sqrt(2) * F.sin(t)
    if name in ("lcc", "aea"):
        p1, p2, p0 = (math.radians(par[k]) for k in ("lat_1", "lat_2", "lat_0"))
        if name == "lcc":
            n = math.sin(p1) if p1 == p2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(math.tan(math.pi / 4 + p2 / 2) / math.tan(math.pi / 4 + p1 / 2))
            f = math.cos(p1) * math.tan(math.pi / 4 + p1 / 2) ** n / n
            rho, rho0 = r * f / F.pow(F.tan(math.pi / 4 + phi / 2), F.lit(n)), r * f / math.tan(math.pi / 4 + p0 / 2) ** n
        else:
            n = (math.sin(p1) + math.sin(p2)) / 2
            c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
            rho, rho0 = r * F.sqrt(F.greatest(c - 2 * n * F.sin(phi), F.lit(0.0))) / n, r * math.sqrt(c - 2 * n * math.sin(p0)) / n
        return rho * F.sin(n * lam), F.lit(rho0) - rho * F.cos(n * lam)
    if name == "tmerc":
        b = F.cos(phi) * F.sin(lam)
        return r * F.log((1 + b) / (1 - b)) / 2, r * (F.atan2(F.tan(phi), F.cos(lam)) - math.radians(par.get("lat_0", 0.0)))
    raise ValueError(f"unknown projection: {name}")


def _conic(name: str, par: dict):
    """Cone constant, radius of the origin's parallel, and latitude of a radius."""
    p1, p2, p0 = (math.radians(par[k]) for k in ("lat_1", "lat_2", "lat_0"))
    r = RADIUS
    if name == "lcc":
        n = math.sin(p1) if p1 == p2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(math.tan(math.pi / 4 + p2 / 2) / math.tan(math.pi / 4 + p1 / 2))
        f = math.cos(p1) * math.tan(math.pi / 4 + p1 / 2) ** n / n
        return n, r * f / math.tan(math.pi / 4 + p0 / 2) ** n, lambda rho: 2 * F.atan(F.pow(r * f / rho, F.lit(1 / n))) - math.pi / 2
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    return n, r * math.sqrt(c - 2 * n * math.sin(p0)) / n, lambda rho: F.asin(F.least(F.greatest((c - (rho * n / r) ** 2) / (2 * n), F.lit(-1.0)), F.lit(1.0)))


def inverse(name: str, x, y, lon0: float = 0.0, **par) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of projected metres."""
    if "shape" in par:
        return par.pop("shape").inverse(name, _col(x), _col(y), lon0, **par)
    x, y, r = _col(x), _col(y), RADIUS
    if name == "latlong":
        return x, y
    if name == "merc":
        return F.degrees(x / r) + lon0, F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)
    if name == "sinu":
        return F.degrees(x / (r * F.cos(y / r))) + lon0, F.degrees(y / r)
    if name == "eqc":
        return F.degrees(x / (r * math.cos(math.radians(par.get("lat_ts", 0.0))))) + lon0, F.degrees(y / r)
    if name == "cea":
        k = math.cos(math.radians(par.get("lat_ts", 0.0)))
        return F.degrees(x / (r * k)) + lon0, F.degrees(F.asin(y * k / r))
    if name == "moll":
        t = F.asin(y / (r * math.sqrt(2)))
        return F.degrees(math.pi * x / (2 * r * math.sqrt(2) * F.cos(t))) + lon0, F.degrees(F.asin((2 * t + F.sin(2 * t)) / math.pi))
    if name in ("lcc", "aea"):
        n, rho0, back = _conic(name, par)
        dy = F.lit(rho0) - y
        rho = F.sqrt(x * x + dy * dy) * math.copysign(1.0, n)
        theta = F.atan2(x * math.copysign(1.0, n), dy * math.copysign(1.0, n))
        return F.degrees(theta / n) + lon0, F.degrees(back(rho))
    if name == "tmerc":
        d = y / r + math.radians(par.get("lat_0", 0.0))
        return F.degrees(F.atan2(F.sinh(x / r), F.cos(d))) + lon0, F.degrees(F.asin(F.sin(d) / F.cosh(x / r)))
    raise ValueError(f"no inverse for projection: {name}")


def reproject(source: str, target: str, x, y, source_par: dict | None = None, target_par: dict | None = None) -> tuple[Column, Column]:
    """Inverse of the source, then forward of the target; both by name with
    parameters, or by ``+proj=`` text."""
    (source, own), (target, other) = definition(source), definition(target)
    scale, x0, y0, par = _frame(own | (source_par or {}))
    x, y = _col(x), _col(y)
    if source == "utm":
        lon, lat = utm_inverse(x, y, par["zone"], par.get("south", False))
    elif source == "latlong":
        lon, lat = x, y
    else:
        lon, lat = inverse(source, (x - x0) / scale, (y - y0) / scale, **par)
    scale, x0, y0, par = _frame(other | (target_par or {}))
    if target == "utm":
        return utm_forward(lon, lat, par["zone"], par.get("south", False))
    if target == "latlong":
        return lon, lat
    px, py = forward(target, lon, lat, **par)
    return px * scale + x0, py * scale + y0


def parse_geo(text) -> Column:
    """Decimal degrees of text such as ``42d 11m 47.75s S`` or ``W33.8``;
    NULL if it is not one."""
    text = F.upper(F.trim(_col(text)))
    lead = F.regexp_extract(text, r"^([NSEW])", 1)
    rest = F.when(lead != "", F.regexp_replace(text, r"^[NSEW]\s*", "")).otherwise(text)
    tail = F.regexp_extract(rest, r"([NEW])$", 1)
    # A trailing S is the mark of seconds after minutes and a number, and a direction elsewhere.
    south = (lead == "") & (tail == "") & rest.rlike(r"(S\s+S|[0-9.DM°'\"]\s*S)$") & ~rest.rlike(r"[M']\s*[0-9.]+\s*S$")
    body = F.when((lead == "") & ((tail != "") | south), F.regexp_replace(rest, r"\s*[NSEW]$", "")).otherwise(rest)
    pattern = r"^([-+]?[0-9.]+)\s*(?:DEG|D|°)?\s*(?:([0-9.]+)\s*(?:MIN|M|'))?\s*(?:([0-9.]+)\s*(?:SEC|S|\"))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(body, pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))
    degrees = F.abs(part(1)) + part(2) / 60 + part(3) / 3600
    negative = body.startswith("-") != ((lead.isin("S", "W")) | (tail == "W") | south)
    return F.when(body.rlike(pattern), F.when(negative, -degrees).otherwise(degrees))
