"""Detections, cameras and motion as native columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from canopy.constants import (
    EARTH_EQUATOR_M, FULL_FRAME_HEIGHT_MM, FULL_FRAME_WIDTH_MM, METERS_PER_DEGREE, SENSOR_FOCAL_MM,
    SENSOR_HEIGHT_MM, SENSOR_WIDTH_MM, STYLE_DEFAULT, STYLE_HIGH, STYLE_LOW, STYLE_MEDIUM,
)


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def clean_confidence(conf) -> Column:
    """0..1: missing or unreadable is 0, above 1.5 is a percentage, the rest is clamped."""
    v = F.coalesce(_c(conf).cast("string").try_cast("double"), F.lit(0.0))
    clamped = F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))
    return F.when(v > 1.5, v / 100).otherwise(clamped)


def class_name(cls, names: Mapping[int, str] | Sequence[str]) -> Column:
    """Name of a class id; unknown ids become their text."""
    pairs = names.items() if isinstance(names, Mapping) else enumerate(names)
    c = _c(cls)
    out = F
    for k, n in pairs:
        out = out.when(c == k, n)
    return out.otherwise(c.cast("string")) if out is not F else c.cast("string")


def confidence_style(conf) -> Column:
    v = _c(conf)
    n = F.greatest(F.lit(0.0), F.least(F.coalesce(v.cast("string").try_cast("double"), F.lit(0.0)), F.lit(1.0)))
    return (
        F.when(v.isNull(), STYLE_DEFAULT).when(n >= 0.8, STYLE_HIGH).when(n >= 0.5, STYLE_MEDIUM).otherwise(STYLE_LOW)
    )


def iou(a: Sequence, b: Sequence) -> Column:
    """Intersection over union of two boxes ``(x1, y1, x2, y2)``; 0 when they do not meet."""
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(
        zero, F.least(ay2, by2) - F.greatest(ay1, by1)
    )
    area = lambda x1, y1, x2, y2: F.greatest(zero, (x2 - x1) * (y2 - y1))
    union = area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - inter
    return F.when((inter <= 0) | (union <= 0), 0.0).otherwise(F.try_divide(inter, union))


def fov_degrees(focal_mm, zoom, hfov: float | None = None, vfov: float | None = None) -> tuple[Column, Column]:
    """Horizontal and vertical field of view from a full-frame equivalent focal length."""
    z = F.when(_c(zoom) > 0, _c(zoom)).otherwise(1.0)
    focal = F.when(_c(focal_mm) > 0, _c(focal_mm) * z)
    angle = lambda mm: F.degrees(2 * F.atan(F.try_divide(F.lit(mm), 2 * focal)))
    h = F.lit(float(hfov)) if hfov is not None else angle(FULL_FRAME_WIDTH_MM)
    v = F.lit(float(vfov)) if vfov is not None else angle(FULL_FRAME_HEIGHT_MM)
    return h, v


def camera_fov(focal_mm, zoom, width: int, height: int, hfov: float | None = None, vfov: float | None = None) -> Column:
    """Field of view and focal lengths in pixels, both axes from their own angle."""
    h, v = fov_degrees(focal_mm, zoom, hfov, vfov)
    return F.struct(
        h.alias("hfov"), v.alias("vfov"),
        F.try_divide(F.lit(width / 2.0), F.tan(F.radians(h) / 2)).alias("fx"),
        F.try_divide(F.lit(height / 2.0), F.tan(F.radians(v) / 2)).alias("fy"),
    )


def _rotate(ray: tuple[Column, Column, Column], yaw: Column, pitch: Column, roll: Column):
    """Roll about x, then pitch about y, then yaw about z (angles in radians)."""
    x, y, z = ray
    y, z = F.cos(roll) * y - F.sin(roll) * z, F.sin(roll) * y + F.cos(roll) * z
    x, z = F.cos(pitch) * x + F.sin(pitch) * z, -F.sin(pitch) * x + F.cos(pitch) * z
    x, y = F.cos(yaw) * x - F.sin(yaw) * y, F.sin(yaw) * x + F.cos(yaw) * y
    return x, y, z


def focal_pixels(width: int, focal_mm, zoom, hfov: float | None = None) -> Column:
    """Focal length in pixels from a horizontal angle or a full-frame equivalent focal length."""
    if hfov is not None:
        return F.lit(width / 2 / math.tan(math.radians(hfov) / 2))
    z = F.when(_c(zoom) > 0, _c(zoom)).otherwise(1.0)
    # tan(hfov / 2) is 36 / (2 f), so the angle itself is not needed.
    return F.when(_c(focal_mm) > 0, _c(focal_mm) * z * (width / FULL_FRAME_WIDTH_MM))


def ground_ray(u, v, width: int, height: int, fx, yaw, pitch, roll) -> tuple[Column, Column, Column]:
    """World direction of a pixel, unnormalised: its camera depth is 1.

    Camera looks along +z, x right, y down; pitch is offset by 90 and roll by 180
    degrees so that pitch -90 points straight down.
    """
    fx = _c(fx)
    x, y = F.try_divide(_c(u) - width / 2.0, fx), F.try_divide(_c(v) - height / 2.0, fx * (height / width))
    return _rotate((x, y, F.lit(1.0)), F.radians(_c(yaw)), F.radians(_c(pitch) + 90), F.radians(_c(roll) + 180))


def ground_point(lat, lon, wx, wy, wz, t) -> tuple[Column, Column, Column]:
    """Latitude, longitude and whether the ray reaches the ground at ``t`` along it."""
    lat, lon, wx, wy, wz, t = map(_c, (lat, lon, wx, wy, wz, t))
    length = F.sqrt(wx * wx + wy * wy + wz * wz)
    hit = (F.abs(wz) >= 1e-6 * length) & (t > 0) & lat.isNotNull() & lon.isNotNull()
    to_deg = 180.0 / math.pi
    glat = lat + t * wy / EARTH_EQUATOR_M * to_deg
    glon = lon + t * wx / (EARTH_EQUATOR_M * F.cos(F.radians(lat))) * to_deg
    return F.when(hit, glat), F.when(hit, glon), hit


def project_to_ground(
    u, v, width: int, height: int, lat, lon, alt, yaw, pitch, roll, fx, ground_alt: float = 0.0
) -> Column:
    """Ground position of a pixel as ``struct(lat, lon)``; NULL when the ray misses the ground.

    ``fx`` is the focal length in pixels. Over a table prefer ``locate_detections``,
    which keeps the steps as columns.
    """
    wx, wy, wz = ground_ray(u, v, width, height, fx, yaw, pitch, roll)
    glat, glon, hit = ground_point(lat, lon, wx, wy, wz, F.try_divide(F.lit(float(ground_alt)) - _c(alt), wz))
    return F.when(hit, F.struct(glat.alias("lat"), glon.alias("lon")))


def project_to_ground_guarded(
    u, v, width: int, height: int, lat, lon, height_m, yaw, pitch, roll, focal_mm, zoom,
    pitch_bias=0.0, max_distance=None,
) -> Column:
    """Second camera model: looks along -z with y up, removes a pitch bias, refuses rays
    that do not point down or reach implausibly far, wraps longitude."""
    u, v, lat, lon, h = map(_c, (u, v, lat, lon, height_m))
    bias = pitch_bias if isinstance(pitch_bias, Column) else F.lit(float(pitch_bias))
    fx = focal_pixels(width, focal_mm, zoom)
    fy = fx * (height / FULL_FRAME_HEIGHT_MM) / (width / FULL_FRAME_WIDTH_MM)
    x, y = F.try_divide(u - width / 2.0, fx), -F.try_divide(v - height / 2.0, fy)
    dx, dy, dz = _rotate(
        (x, y, F.lit(-1.0)), F.radians(_c(yaw)), F.radians(_c(pitch) - bias + 90), F.radians(_c(roll))
    )
    t = F.try_divide(h, -dz)
    east, north = dx * t, dy * t
    limit = F.greatest(15 * h, F.lit(500.0))
    if max_distance is not None:
        limit = F.greatest(limit, _c(max_distance))
    glat = lat + north / METERS_PER_DEGREE
    glon = lon + F.try_divide(east, METERS_PER_DEGREE * F.cos(F.radians(lat)))
    length = F.sqrt(x * x + y * y + 1)
    ok = (dz < -1e-3 * length) & (F.sqrt(east * east + north * north) <= limit) & glat.between(-90, 90)
    wrapped = F.pmod(glon + 180, F.lit(360.0)) - 180
    return F.when(ok, F.struct(glat.alias("lat"), wrapped.alias("lon")))


def ground_sampling_distance(altitude, pixels: int, sensor_mm: float, focal_mm: float = SENSOR_FOCAL_MM) -> Column:
    """Metres on the ground per pixel."""
    return _c(altitude) * sensor_mm / (focal_mm * pixels)


def locate_by_gsd(
    x1, y1, x2, y2, north, east, altitude, heading, width: int, height: int,
    focal_mm: float = SENSOR_FOCAL_MM, sensor_width: float = SENSOR_WIDTH_MM, sensor_height: float = SENSOR_HEIGHT_MM,
) -> Column:
    """Planar position (north, east) of a box centre around the drone's position."""
    cx, cy = F.floor((_c(x1) + _c(x2)) / 2), F.floor((_c(y1) + _c(y2)) / 2)
    d_east = (cx - width // 2) * ground_sampling_distance(altitude, width, sensor_width, focal_mm)
    d_north = (height // 2 - cy) * ground_sampling_distance(altitude, height, sensor_height, focal_mm)
    a = -_c(heading)
    return F.struct(
        (_c(north) + F.cos(a) * d_north - F.sin(a) * d_east).alias("north"),
        (_c(east) + F.sin(a) * d_north + F.cos(a) * d_east).alias("east"),
    )


def travel_radius(speed, t, kind: str = "linear", limit: float = 30.0, a: float = 70, base: float = 1.15) -> Column:
    """Distance an animal may have moved in ``t`` seconds."""
    s, t = (_c(v) if isinstance(v, (str, Column)) else F.lit(float(v)) for v in (speed, t))
    linear = s * t
    if kind == "linear":
        return linear
    if kind == "limited":
        return F.least(F.lit(float(limit)), linear)
    if kind == "reciprocal":
        n = F.ceil(t).cast("int")
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return s * F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + a / (a + k))
    log = s * F.log(t) / math.log(base)
    if kind == "log":
        return log
    if kind == "min_linear_log":
        return F.least(linear, log)
    raise ValueError(kind)
