"""Map projections on an ellipsoid, forward and back, as Column arithmetic.

Forward formulas are closed: they go by the isometric latitude (merc, lcc, tmerc)
or by the authalic function (cea, aea).  The ways back are series: from conformal
to geodetic latitude in the third flattening, and from authalic latitude in the
eccentricity.  Nothing is iterated, so that a projection stays one expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equatorial axis in metres and inverse flattening of named ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "WGS72": (6378135.0, 298.26),
    "aust_SA": (6378160.0, 298.25),
    "bessel": (6377397.155, 299.1528128),
    "intl": (6378388.0, 297.0),
    "krass": (6378245.0, 298.3),
}
#: Equatorial and polar axis in metres, of ellipsoids that are named by both.
BY_AXES = {"airy": (6377563.396, 6356256.910), "clrk66": (6378206.4, 6356583.8), "clrk80": (6378249.145, 6356514.966)}
#: Ellipsoids of datums; no shift between datums is applied.
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66", "OSGB36": "airy"}
#: Projections with a form on the ellipsoid.
NAMES = ("merc", "lcc", "aea", "cea", "tmerc")
#: Degrees of longitude from its meridian within which the transverse series holds.
TRANSVERSE_REACH = 45.0


@dataclass(frozen=True)
class Ellipsoid:
    """axis: equatorial radius in metres; flattening: 0 for a sphere."""

    axis: float
    flattening: float

    @classmethod
    def of(cls, given: dict[str, str]) -> Ellipsoid | None:
        """Takes datum, ellps, a, b, rf and f out of projection parameters; None
        if they name no ellipsoid (an axis ``a`` alone stays, as a radius)."""
        datum, name = given.pop("datum", None), given.pop("ellps", None)
        if datum is not None:
            if datum not in DATUMS:
                raise ValueError(f"unknown datum: {datum}")
            name = name or DATUMS[datum]
        b, rf, f = (float(given.pop(k)) if k in given else None for k in ("b", "rf", "f"))
        if name is None and b is None and rf is None and f is None:
            return None
        axis, flattening = None, 0.0
        if name == "sphere":
            axis = 6370997.0
        elif name in ELLIPSOIDS:
            axis, flattening = ELLIPSOIDS[name][0], 1 / ELLIPSOIDS[name][1]
        elif name in BY_AXES:
            axis, polar = BY_AXES[name]
            flattening = 1 - polar / axis
        elif name is not None:
            raise ValueError(f"unknown ellipsoid: {name}")
        axis = float(given.pop("a")) if "a" in given else axis
        if axis is None:
            raise ValueError("an ellipsoid needs ellps, datum or a")
        flattening = 1 - b / axis if b is not None else 1 / rf if rf is not None else f if f is not None else flattening
        if not (axis > 0 and 0 <= flattening < 0.1):
            raise ValueError(f"no such ellipsoid: a={axis} f={flattening}")
        return cls(axis, flattening)

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @cached_property
    def n(self) -> float:
        """Third flattening."""
        return self.flattening / (2 - self.flattening)

    @cached_property
    def meridian(self) -> float:
        """Radius of the sphere with meridians of the ellipsoid's length."""
        return self.axis / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)

    @cached_property
    def krueger(self) -> tuple[tuple[float, ...], ...]:
        """Series to the third order: to the transverse grid, back from it, and from conformal to geodetic latitude."""
        n = self.n
        to = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
        back = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
        return to, back, (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)

    @cached_property
    def authalic(self) -> tuple[float, ...]:
        """Series from authalic to geodetic latitude."""
        e2 = self.e**2
        return (e2 / 3 + 31 / 180 * e2**2 + 517 / 5040 * e2**3, 23 / 360 * e2**2 + 251 / 3780 * e2**3, 761 / 45360 * e2**3)

    # --- auxiliary latitudes; ``m`` is the module of functions: math for constants, Spark's for columns ----------

    def isometric(self, phi, m=F):
        return m.log(m.tan(math.pi / 4 + phi / 2)) - self.e * m.atanh(self.e * m.sin(phi))

    def q(self, phi, m=F):
        """Authalic function: q(90 degrees) times the sine of the authalic latitude."""
        if not self.e:
            return 2 * m.sin(phi)
        es = self.e * m.sin(phi)
        return (1 - self.e**2) * (m.sin(phi) / (1 - es * es) + m.atanh(es) / self.e)

    def parallel(self, phi: float) -> float:
        """Radius of a parallel, in axes."""
        return math.cos(phi) / math.sqrt(1 - (self.e * math.sin(phi)) ** 2)

    def of_conformal(self, chi: Column) -> Column:
        return chi + sum(k * F.sin(2 * j * chi) for j, k in enumerate(self.krueger[2], 1))

    def of_authalic(self, sine: Column) -> Column:
        """Geodetic latitude of an authalic latitude's sine; NULL outside -1 to 1 (but for rounding)."""
        beta = F.asin(F.greatest(F.least(sine, F.lit(1.0)), F.lit(-1.0)))
        return F.when(F.abs(sine) <= 1 + 1e-12, beta + sum(k * F.sin(2 * j * beta) for j, k in enumerate(self.authalic, 1)))

    def _cone(self, name: str, par: dict):
        """Cone constant and what the radius of a parallel needs; the origin's radius."""
        p1, p2, p0 = (math.radians(par[k]) for k in ("lat_1", "lat_2", "lat_0"))
        m1, m2 = self.parallel(p1), self.parallel(p2)
        if abs(p1 + p2) < 1e-10:
            raise ValueError("the standard parallels of a cone must not be opposite")
        if name == "lcc":
            u1, u2 = self.isometric(p1, math), self.isometric(p2, math)
            n = math.sin(p1) if p1 == p2 else (math.log(m1) - math.log(m2)) / (u2 - u1)
            c = self.axis * m1 * math.exp(n * u1) / n
            return n, c, c * math.exp(-n * self.isometric(p0, math))
        q1, q2 = self.q(p1, math), self.q(p2, math)
        n = math.sin(p1) if p1 == p2 else (m1**2 - m2**2) / (q2 - q1)
        c = m1**2 + n * q1
        return n, c, self.axis * math.sqrt(c - n * self.q(p0, math)) / n

    def _transverse_origin(self, lat_0: float) -> float:
        xi = math.atan(math.sinh(self.isometric(math.radians(lat_0), math)))
        return xi + sum(k * math.sin(2 * j * xi) for j, k in enumerate(self.krueger[0], 1))

    # --- projections ---------------------------------------------------------------------------------------------

    def forward(self, name: str, lon: Column, lat: Column, lon0: float = 0.0, **par) -> tuple[Column, Column]:
        """Metres of degrees; NULL where the projection has no place: latitudes beyond 90 degrees, the poles of
        merc and lcc, and longitudes beyond ``TRANSVERSE_REACH`` from tmerc's meridian."""
        lam, phi, a = F.radians(lon - lon0), F.radians(lat), self.axis
        inside = F.abs(lat) <= 90 if name in ("cea", "aea") else F.abs(lat) < 90
        if name == "merc":
            k = self.parallel(math.radians(par.get("lat_ts", 0.0)))
            x, y = a * k * lam, a * k * self.isometric(phi)
        elif name == "cea":
            k = self.parallel(math.radians(par.get("lat_ts", 0.0)))
            x, y = a * k * lam, a / (2 * k) * self.q(phi)
        elif name in ("lcc", "aea"):
            n, c, rho0 = self._cone(name, par)
            rho = c * F.exp(-n * self.isometric(phi)) if name == "lcc" else a / n * F.sqrt(F.greatest(c - n * self.q(phi), F.lit(0.0)))
            x, y = rho * F.sin(n * lam), rho0 - rho * F.cos(n * lam)
        elif name == "tmerc":
            t = F.sinh(self.isometric(phi))
            xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
            east = sum(k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(self.krueger[0], 1))
            north = sum(k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(self.krueger[0], 1))
            x, y = self.meridian * (eta + east), self.meridian * (xi + north - self._transverse_origin(par.get("lat_0", 0.0)))
            inside &= F.abs(lon - lon0) <= TRANSVERSE_REACH
        else:
            raise ValueError(f"no form on the ellipsoid: {name}")
        return F.when(inside, x), F.when(inside, y)

    def inverse(self, name: str, x: Column, y: Column, lon0: float = 0.0, **par) -> tuple[Column, Column]:
        """Degrees of metres; NULL outside the projection's image."""
        a = self.axis
        if name == "merc":
            k = self.parallel(math.radians(par.get("lat_ts", 0.0)))
            lam, phi = x / (a * k), self.of_conformal(F.atan(F.sinh(y / (a * k))))
        elif name == "cea":
            k = self.parallel(math.radians(par.get("lat_ts", 0.0)))
            lam, phi = x / (a * k), self.of_authalic(2 * k / (a * self.q(math.pi / 2, math)) * y)
        elif name in ("lcc", "aea"):
            n, c, rho0 = self._cone(name, par)
            sign = math.copysign(1.0, n)
            dy = rho0 - y
            rho = sign * F.sqrt(x * x + dy * dy)
            lam = F.atan2(sign * x, sign * dy) / n
            if name == "lcc":
                phi = self.of_conformal(F.atan(F.sinh(-F.log(rho / c) / n)))
            else:
                phi = self.of_authalic((c - (rho * n / a) ** 2) / (n * self.q(math.pi / 2, math)))
        elif name == "tmerc":
            xi, eta = y / self.meridian + self._transverse_origin(par.get("lat_0", 0.0)), x / self.meridian
            north = sum(k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(self.krueger[1], 1))
            east = sum(k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(self.krueger[1], 1))
            xi, eta = xi - north, eta - east
            lam, phi = F.atan2(F.sinh(eta), F.cos(xi)), self.of_conformal(F.asin(F.sin(xi) / F.cosh(eta)))
        else:
            raise ValueError(f"no form on the ellipsoid: {name}")
        known = phi.isNotNull()
        return F.when(known, F.degrees(lam) + lon0), F.degrees(phi)
