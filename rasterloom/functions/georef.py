"""World and pixel coordinates of north-up grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    """x = a * col + b * row + c, y = d * col + e * row + f; b and d are 0 for a north-up grid."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def shifted(self, row: int, col: int) -> Affine:
        return Affine(self.a, self.b, self.c + self.a * col + self.b * row, self.d, self.e, self.f + self.d * col + self.e * row)


@dataclass(frozen=True)
class Grid:
    """Header of a raster."""

    raster_id: str
    width: int
    height: int
    transform: Affine
    crs: str = "EPSG:32633"
    band_count: int = 1
    dtype: str = "float32"
    nodata: float | None = None
    driver: str = "parquet"
    path: str = ""

    @property
    def epsg(self) -> int | None:
        """The number of the coordinate system, if it has one."""
        kind, _, number = self.crs.partition(":")
        return int(number) if kind == "EPSG" and number.isdigit() else None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top"""
        t = self.transform
        return t.c, t.f + t.e * self.height, t.c + t.a * self.width, t.f


def column_of(x: Column, t: Affine) -> Column:
    return F.floor((x - F.lit(t.c)) / F.lit(t.a)).cast("int")


def row_of(y: Column, t: Affine) -> Column:
    return F.floor((y - F.lit(t.f)) / F.lit(t.e)).cast("int")


def origin_of(row: Column, col: Column, t: Affine) -> tuple[Column, Column]:
    """World coordinates of a pixel's corner."""
    return F.lit(t.c) + F.lit(t.a) * col, F.lit(t.f) + F.lit(t.e) * row


def pixel_bounds(row: Column, col: Column, half: int) -> list[Column]:
    """row - half, col - half, row + half, col + half under the names the helper has always had."""
    return [(row - half).alias("px_min"), (col - half).alias("py_min"), (row + half).alias("px_max"), (col + half).alias("py_max")]


RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
_N = FLATTENING / (2 - FLATTENING)
#: Krueger's series for the transverse Mercator projection, to the fourth power of the third flattening.
TO_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280,
)
FROM_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280,
)
TO_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630,
)
#: Metres for one radian along the central meridian, with the scale of UTM.
UTM_SCALE = 0.9996 * RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def utm_zone(crs: str) -> tuple[int, float] | None:
    """Central meridian in degrees and false northing of a UTM system (WGS 84, north or south, or ETRS89), else None."""
    kind, _, code = crs.partition(":")
    if kind != "EPSG" or not code.isdigit() or int(code) // 100 not in (326, 327, 258) or not 1 <= int(code) % 100 <= 60:
        return None
    return int(code) % 100 * 6 - 183, 1e7 if int(code) // 100 == 327 else 0.0


class Arrays:
    """NumPy's functions under the names that Spark's have."""

    sin, cos, tan, sinh, cosh, sqrt, exp, log, radians, degrees = np.sin, np.cos, np.tan, np.sinh, np.cosh, np.sqrt, np.exp, np.log, np.radians, np.degrees
    asin, atan, atan2, atanh = np.arcsin, np.arctan, np.arctan2, np.arctanh


def _to_utm(lon, lat, meridian: int, northing: float, m=F) -> tuple:
    s, turn, e = m.sin(m.radians(lat)), m.radians(lon - meridian), ECCENTRICITY
    t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
    xi, eta = m.atan2(t, m.cos(turn)), m.atanh(m.sin(turn) / m.sqrt(1 + t * t))
    up, right = xi, eta
    for j, c in enumerate(TO_PLANE, 1):
        up, right = up + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta), right + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    return 500000.0 + UTM_SCALE * right, northing + UTM_SCALE * up


def _from_utm(x, y, meridian: int, northing: float, m=F) -> tuple:
    xi, eta = (y - northing) / UTM_SCALE, (x - 500000.0) / UTM_SCALE
    up, right = xi, eta
    for j, c in enumerate(FROM_PLANE, 1):
        up, right = up - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta), right - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(up) / m.cosh(right))
    lat = chi
    for j, c in enumerate(TO_LATITUDE, 1):
        lat = lat + c * m.sin(2 * j * chi)
    return meridian + m.degrees(m.atan2(m.sinh(right), m.cos(up))), m.degrees(lat)


def reproject(x, y, source: str, target: str, m=F) -> tuple:
    """Coordinates in another system: degrees (EPSG:4326), spherical Mercator (EPSG:3857) or UTM; others are refused.

    Columns with Spark's functions, or arrays with `m=Arrays`.
    """
    if source == target:
        return x, y
    known = lambda crs: crs in ("EPSG:4326", "EPSG:3857") or utm_zone(crs) is not None
    if not known(source) or not known(target):
        raise ValueError(f"no transformation from {source} to {target}")
    if zone := utm_zone(source):
        x, y = _from_utm(x, y, *zone, m)
    elif source == "EPSG:3857":
        x, y = m.degrees(x / RADIUS), m.degrees(2 * m.atan(m.exp(y / RADIUS)) - math.pi / 2)
    if zone := utm_zone(target):
        return _to_utm(x, y, *zone, m)
    if target == "EPSG:3857":
        return m.radians(x) * RADIUS, m.log(m.tan(math.pi / 4 + m.radians(y) / 2)) * RADIUS
    return x, y


def intersect(*grids: Grid) -> tuple[float, float, float, float]:
    """Common bounds of grids of one coordinate system."""
    if len({g.crs for g in grids}) > 1:
        raise ValueError("the rasters have different coordinate systems")
    left, bottom, right, top = (max(g.bounds[0] for g in grids), max(g.bounds[1] for g in grids), min(g.bounds[2] for g in grids), min(g.bounds[3] for g in grids))
    if left >= right or bottom >= top:
        raise ValueError("the rasters do not overlap")
    return left, bottom, right, top
