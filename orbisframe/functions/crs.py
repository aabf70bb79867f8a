"""Coordinate systems: geographic WGS84 (4326), web Mercator (3857) and UTM (326zz, 327zz), as Column or float math."""

from __future__ import annotations

import math
import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_K0 = 0.9996
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the third order in n: forward, inverse, and conformal to geodetic latitude.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


class CRS:
    """One of the supported systems; None stands for 4326."""

    def __init__(self, of=None):
        if isinstance(of, CRS):
            of = of.epsg
        found = re.fullmatch(r"(?:EPSG:)?(\d+)", str(4326 if of is None else of).strip(), re.I)
        self.epsg = int(found[1]) if found else 0
        if self.epsg not in (4326, 3857) and not (self.epsg // 100 in (326, 327) and 1 <= self.epsg % 100 <= 60):
            raise ValueError(f"unsupported coordinate system {of!r}")

    @property
    def is_geographic(self) -> bool:
        return self.epsg == 4326

    @property
    def is_projected(self) -> bool:
        return not self.is_geographic

    def to_string(self) -> str:
        return f"EPSG:{self.epsg}"

    def __eq__(self, other) -> bool:
        try:
            return self.epsg == CRS(other).epsg
        except ValueError:
            return False

    __hash__ = None

    def __repr__(self) -> str:
        return f"CRS({self.to_string()})"


def utm_epsg(lon: float, lat: float) -> int:
    """The UTM zone of a place; zone 60 at 180 degrees east."""
    return (32600 if lat >= 0 else 32700) + min(60, int((lon + 180) // 6) + 1)


def check_compatible(a: CRS, b: CRS) -> None:
    if not a == b:
        warnings.warn(f"coordinate systems differ: {a.to_string()} and {b.to_string()}", UserWarning, stacklevel=3)


class _Floats:
    """The functions that the formulas need, over floats."""

    sin, cos, sinh, cosh, tan, atan, atan2, exp, asin, tanh = (
        math.sin, math.cos, math.sinh, math.cosh, math.tan, math.atan, math.atan2, math.exp, math.asin, math.tanh,
    )
    log, atanh, radians, degrees, sqrt, asinh = math.log, math.atanh, math.radians, math.degrees, math.sqrt, math.asinh


class _Columns:
    """The same over Columns."""

    sin, cos, sinh, cosh, tan, atan, atan2, exp, asin, tanh = F.sin, F.cos, F.sinh, F.cosh, F.tan, F.atan, F.atan2, F.exp, F.asin, F.tanh
    log, atanh, radians, degrees, sqrt, asinh = F.ln, F.atanh, F.radians, F.degrees, F.sqrt, F.asinh


def transform(x, y, src, dst):
    """(x, y) in dst from src; Columns or floats."""
    src, dst = CRS(src), CRS(dst)
    if src == dst:
        return x, y
    lib = _Columns if isinstance(x, Column) else _Floats
    lon, lat = (x, y) if src.is_geographic else _mercator_back(x, y, lib) if src.epsg == 3857 else _utm_back(x, y, src.epsg, lib)
    if dst.is_geographic:
        return lon, lat
    return _mercator(lon, lat, lib) if dst.epsg == 3857 else _utm(lon, lat, dst.epsg, lib)


def _mercator(lon, lat, lib):
    return lib.radians(lon) * _A, lib.asinh(lib.tan(lib.radians(lat))) * _A


def _mercator_back(x, y, lib):
    return lib.degrees(x / _A), lib.degrees(lib.atan(lib.sinh(y / _A)))


def _utm(lon, lat, epsg: int, lib):
    e2 = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = lib.radians(lat), lib.radians(lon) - math.radians(epsg % 100 * 6 - 183)
    t = lib.sinh(lib.atanh(lib.sin(phi)) - lib.atanh(lib.sin(phi) * e2) * e2)
    xi, eta = lib.atan2(t, lib.cos(lam)), lib.atanh(lib.sin(lam) / lib.sqrt(t * t + 1))
    east, north = eta, xi
    for j, alpha in enumerate(_ALPHA, 1):
        east = east + lib.cos(xi * (2 * j)) * lib.sinh(eta * (2 * j)) * alpha
        north = north + lib.sin(xi * (2 * j)) * lib.cosh(eta * (2 * j)) * alpha
    return east * (_K0 * _R) + 500000.0, north * (_K0 * _R) + (0.0 if epsg < 32700 else 10000000.0)


def _utm_back(x, y, epsg: int, lib):
    xi, eta = (y - (0.0 if epsg < 32700 else 10000000.0)) / (_K0 * _R), (x - 500000.0) / (_K0 * _R)
    xi2, eta2 = xi, eta
    for j, beta in enumerate(_BETA, 1):
        xi2 = xi2 - lib.sin(xi * (2 * j)) * lib.cosh(eta * (2 * j)) * beta
        eta2 = eta2 - lib.cos(xi * (2 * j)) * lib.sinh(eta * (2 * j)) * beta
    chi = lib.asin(lib.sin(xi2) / lib.cosh(eta2))
    lat = chi
    for j, delta in enumerate(_DELTA, 1):
        lat = lat + lib.sin(chi * (2 * j)) * delta
    return lib.degrees(lib.atan2(lib.sinh(eta2), lib.cos(xi2))) + float(epsg % 100 * 6 - 183), lib.degrees(lat)


def transform_bounds(bounds: tuple[float, float, float, float], src, dst, densify: int = 21) -> tuple[float, float, float, float]:
    """The box around a box's edges, densify points an edge, in another system."""
    if CRS(src) == CRS(dst):
        return bounds
    x0, y0, x1, y1 = bounds
    steps = [i / (densify - 1) for i in range(densify)]
    ring = [(x0 + (x1 - x0) * s, y) for s in steps for y in (y0, y1)] + [(x, y0 + (y1 - y0) * s) for s in steps for x in (x0, x1)]
    xs, ys = zip(*[transform(x, y, src, dst) for x, y in ring], strict=True)
    return min(xs), min(ys), max(xs), max(ys)
