"""Map projections as native columns: transverse Mercator (Krueger series) and web Mercator."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WEB_RADIUS = 6378137.0


@dataclass(frozen=True)
class TransverseMercator:
    central_meridian: float
    scale: float
    false_easting: float
    false_northing: float
    flattening: float
    axis: float = 6378137.0

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        n = self.n
        return self.scale * self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    # Krueger series coefficients to the fourth power of n.
    def alpha(self) -> list[float]:
        n = self.n
        return [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ]

    def beta(self) -> list[float]:
        n = self.n
        return [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ]

    def delta(self) -> list[float]:
        n = self.n
        return [
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        ]


WGS84_F, GRS80_F = 1 / 298.257223563, 1 / 298.257222101


def transverse_mercator(epsg: int) -> TransverseMercator | None:
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        zone = epsg % 100
        return TransverseMercator(zone * 6 - 183, 0.9996, 500000.0, 0.0 if epsg < 32700 else 1e7, WGS84_F)
    if epsg == 3346:
        return TransverseMercator(24.0, 0.9998, 500000.0, 0.0, GRS80_F)
    return None


def _tm_forward(lon: Column, lat: Column, p: TransverseMercator) -> tuple[Column, Column]:
    k = 2 * math.sqrt(p.n) / (1 + p.n)
    s = F.sin(F.radians(lat))
    dl = F.radians(lon - p.central_meridian)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(p.alpha(), 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return p.false_easting + p.radius * east, p.false_northing + p.radius * north


def _tm_inverse(x: Column, y: Column, p: TransverseMercator) -> tuple[Column, Column]:
    xi, eta = (y - p.false_northing) / p.radius, (x - p.false_easting) / p.radius
    xp, ep = xi, eta
    for j, b in enumerate(p.beta(), 1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, d in enumerate(p.delta(), 1):
        lat = lat + d * F.sin(2 * j * chi)
    return p.central_meridian + F.degrees(F.atan2(F.sinh(ep), F.cos(xp))), F.degrees(lat)


def to_lonlat(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return F.degrees(x / WEB_RADIUS), F.degrees(2 * F.atan(F.exp(y / WEB_RADIUS)) - math.pi / 2)
    p = transverse_mercator(epsg)
    if p is None:
        raise ValueError(f"EPSG:{epsg} is not supported")
    return _tm_inverse(x, y, p)


def from_lonlat(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return WEB_RADIUS * F.radians(lon), WEB_RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))
    p = transverse_mercator(epsg)
    if p is None:
        raise ValueError(f"EPSG:{epsg} is not supported")
    return _tm_forward(lon, lat, p)


def reproject_xy(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    if source == target:
        return x, y
    lon, lat = to_lonlat(x, y, source)
    return from_lonlat(lon, lat, target)


def reproject(df: DataFrame, x: str, y: str, source: int, target: int) -> DataFrame:
    """Point columns ``x`` and ``y`` (longitude first) from one EPSG code to another."""
    if source == target:
        return df
    lon, lat = to_lonlat(F.col(x), F.col(y), source)
    mid = df.withColumn("__lon", lon).withColumn("__lat", lat)
    nx, ny = from_lonlat(F.col("__lon"), F.col("__lat"), target)
    return mid.withColumn("__nx", nx).withColumn("__ny", ny).withColumn(x, F.col("__nx")).withColumn(
        y, F.col("__ny")
    ).drop("__lon", "__lat", "__nx", "__ny")


def reproject_ring(xy: str, source: int, target: int) -> Column:
    """A ring column, point by point."""

    def point(p: Column) -> Column:
        nx, ny = reproject_xy(p["x"], p["y"], source, target)
        return F.struct(nx.alias("x"), ny.alias("y"))

    return F.transform(xy, point)
