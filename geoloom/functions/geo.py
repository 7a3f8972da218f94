"""Column functions of geometry: projections, tiles, distances, segments."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS = 6378137.0
MAX_LATITUDE = 85.05112878
DEG = math.pi / 180.0
FEATURE_ZOOM = 14
WORLD_TILE = 300.0
RADIUS_DEFAULT, RADIUS_MIN, RADIUS_MAX = 500.0, 100.0, 1000.0


def local_x(lon, lon0, lat0) -> Column:
    """Metres east of the seed."""
    return (lon - lon0) * DEG * EARTH_RADIUS * F.cos(lat0 * DEG)


def local_z(lat, lat0) -> Column:
    """Metres south of the seed."""
    return -((lat - lat0) * DEG * EARTH_RADIUS)


def lon_of(x, lon0, lat0) -> Column:
    return lon0 + x / (EARTH_RADIUS * F.cos(lat0 * DEG)) / DEG


def lat_of(z, lat0) -> Column:
    return lat0 - z / EARTH_RADIUS / DEG


def haversine(lon1, lat1, lon2, lat2) -> Column:
    a, b = F.sin((lat2 - lat1) * DEG / 2), F.sin((lon2 - lon1) * DEG / 2)
    h = a * a + F.cos(lat1 * DEG) * F.cos(lat2 * DEG) * b * b
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(h))


def tile_x(lon, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat, zoom: int) -> Column:
    n = 1 << zoom
    clamped = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1 - F.asinh(F.tan(clamped * DEG)) / math.pi) / 2 * n))).cast("int")


def delta_lat(metres) -> Column:
    return metres / EARTH_RADIUS / DEG


def delta_lon(metres, lat0) -> Column:
    return metres / (EARTH_RADIUS * F.cos(lat0 * DEG)) / DEG


def clamp(x, low, high) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_up(x) -> Column:
    """Round halves towards positive infinity."""
    return F.floor(x + 0.5)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def project(px, pz, ax, az, bx, bz) -> dict[str, Column]:
    """The point of a segment nearest to p: x, z, t in [0, 1] and the distance."""
    dx, dz = bx - ax, bz - az
    square = dx * dx + dz * dz
    t = F.when(square == 0, 0.0).otherwise(clamp(((px - ax) * dx + (pz - az) * dz) / F.when(square != 0, square), 0.0, 1.0))
    x, z = ax + dx * t, az + dz * t
    return {"x": x, "z": z, "t": t, "distance": F.sqrt((px - x) * (px - x) + (pz - z) * (pz - z))}


def clip_to_circle(ax, az, bx, bz, r) -> dict[str, Column]:
    """The parameters t0 <= t1 of a segment's part inside a circle about the origin; null where it has none.

    A segment of no length stays where its point is inside.
    """
    dx, dz = bx - ax, bz - az
    a = dx * dx + dz * dz
    b = 2 * (ax * dx + az * dz)
    c = ax * ax + az * az - r * r
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    safe = F.when(a > 0, 2 * a)
    low, high = F.greatest(F.lit(0.0), (-b - root) / safe), F.least(F.lit(1.0), (-b + root) / safe)
    crosses = (a > 0) & (b * b - 4 * a * c >= 0) & (low <= high)
    point = (a == 0) & (c <= 0)
    return {"t0": F.when(crosses, low).when(point, 0.0), "t1": F.when(crosses, high).when(point, 1.0)}


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over a text's UTF-16 units (characters of the basic plane)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619 % 4294967296)


def seeded_unit(text: Column) -> Column:
    """A number in [0, 1] that a text determines."""
    return fnv1a(text) / 4294967295.0


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of (x, z), the last vertex joined to the first."""
    n = F.size(ring)
    pairs = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["z"] - F.get(ring, (i + 1) % n)["x"] * p["z"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2


def ring_mean(ring: Column, axis: str) -> Column:
    return F.aggregate(F.transform(ring, lambda p: p[axis]), F.lit(0.0), lambda s, x: s + x) / F.size(ring)
