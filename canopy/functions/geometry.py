"""Geodesy, tiles and planar geometry as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from canopy.constants import EARTH_MEAN_M, METERS_PER_DEGREE


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def dms_to_decimal(d, m, s, ref) -> Column:
    v = _c(d) + _c(m) / 60 + _c(s) / 3600
    return F.when(_c(ref).isin("S", "W"), -v).otherwise(v)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = _c(lat1), _c(lon1), _c(lat2), _c(lon2)
    sp, sl = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = sp * sp + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sl * sl
    return 2 * EARTH_MEAN_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1e-12), 1 - a)))


def local_offset_m(lat, lon, ref_lat, ref_lon) -> Column:
    """East and north metres from a reference, scaled at the middle latitude."""
    lat, lon, ref_lat, ref_lon = _c(lat), _c(lon), _c(ref_lat), _c(ref_lon)
    per_lon = METERS_PER_DEGREE * F.cos(F.radians((lat + ref_lat) * 0.5))
    return F.struct(
        ((lon - ref_lon) * per_lon).alias("east"), ((lat - ref_lat) * METERS_PER_DEGREE).alias("north")
    )


def to_local_m(lat, lon, origin_lat, origin_lon) -> Column:
    """East and north metres from an origin, scaled at the origin's latitude."""
    lat, lon, olat, olon = _c(lat), _c(lon), _c(origin_lat), _c(origin_lon)
    per_lon = METERS_PER_DEGREE * F.cos(F.radians(olat))
    return F.struct(((lon - olon) * per_lon).alias("east"), ((lat - olat) * METERS_PER_DEGREE).alias("north"))


def utm_zone(lon, lat) -> Column:
    """UTM zone with the Norway and Svalbard exceptions."""
    lon, lat = _c(lon), _c(lat)
    wrapped = F.pmod(lon + 180, F.lit(360.0)) - 180
    zone = (F.floor((wrapped + 180) / 6) + 1).cast("int")
    svalbard = (lat >= 72) & (lat <= 84) & (wrapped >= 0)
    return (
        F.when((lat >= 56) & (lat < 64) & (wrapped >= 3) & (wrapped < 12), 32)
        .when(svalbard & (wrapped < 9), 31)
        .when(svalbard & (wrapped < 21), 33)
        .when(svalbard & (wrapped < 33), 35)
        .when(svalbard & (wrapped < 42), 37)
        .otherwise(zone)
    )


def utm_epsg(lon, lat) -> Column:
    return F.when(_c(lat) >= 0, 32600).otherwise(32700) + utm_zone(lon, lat)


def epsg_of_tile(tile) -> Column:
    """EPSG code from a tile name such as ``T35ULA`` or ``35ULA``."""
    t = F.regexp_replace(_c(tile), "^T(?=[0-9]{2})", "")
    zone = t.substr(F.lit(1), F.lit(2)).try_cast("int")
    north = t.substr(F.lit(3), F.lit(1)).between("N", "X")
    return F.when(north, 32600).otherwise(32700) + zone


def parse_epsg(value) -> Column:
    """EPSG number from ``4326``, ``EPSG:3857``, an OGC URN or ``CRS84``; else NULL."""
    v = F.trim(_c(value))
    urn = F.regexp_extract(v, r"(?i)^urn:ogc:def:crs:.+::(.+)$", 1)
    code = F.when(F.lower(v).contains("urn:ogc:def:crs"), urn).otherwise(v)
    number = F.regexp_replace(code, "(?i)epsg:", "")
    return F.when(F.upper(code) == "CRS84", 4326).otherwise(F.trim(number).try_cast("int"))


def lonlat_to_tile(lon, lat, zoom: int) -> Column:
    """Web-mercator tile indices."""
    n = 2**zoom
    phi = F.radians(F.greatest(F.least(_c(lat), F.lit(85.05112878)), F.lit(-85.05112878)))
    x = (_c(lon) + 180) / 360 * n
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n
    # Truncation toward zero and flooring agree after the clamp at 0.
    clamp = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    return F.struct(clamp(x).alias("x"), clamp(y).alias("y"))


def tile_bounds(x, y, zoom: int) -> Column:
    n = float(2**zoom)
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    x, y = _c(x), _c(y)
    return F.struct(
        lon(x).alias("lon_min"), lat(y + 1).alias("lat_min"), lon(x + 1).alias("lon_max"), lat(y).alias("lat_max")
    )


def ring_edges(xy) -> Column:
    """Consecutive point pairs of a ring, closed when its ends differ."""
    p = _c(xy)
    first, last = F.get(p, 0), F.get(p, F.size(p) - 1)
    closed = F.when(first == last, p).otherwise(F.concat(p, F.array(first)))
    return F.transform(
        F.slice(closed, 1, F.size(closed) - 1),
        lambda a, i: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"),
            F.get(closed, i + 1)["x"].alias("x2"), F.get(closed, i + 1)["y"].alias("y2"),
        ),
    )


def ring_cross_sums(xy) -> Column:
    """Twice the signed area and the two centroid moments of a ring."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(s: Column, e: Column) -> Column:
        k = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (s["a"] + k).alias("a"), (s["mx"] + (e["x1"] + e["x2"]) * k).alias("mx"),
            (s["my"] + (e["y1"] + e["y2"]) * k).alias("my"),
        )

    return F.aggregate(ring_edges(xy), zero, add)


def in_ring(x, y, xy) -> Column:
    """Even-odd containment; an edge owns its lower end (``y1 <= y < y2``)."""
    px, py = _c(x), _c(y)

    def flips(e: Column) -> Column:
        spans = ((e["y1"] <= py) & (py < e["y2"])) | ((e["y2"] <= py) & (py < e["y1"]))
        at = e["x1"] + F.try_divide((py - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return F.when(spans & (px < at), 1).otherwise(0)

    return F.aggregate(ring_edges(xy), F.lit(0), lambda s, e: s + flips(e)) % 2 == 1
