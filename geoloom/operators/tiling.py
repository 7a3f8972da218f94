"""Seeds, boxes, tiles and local metres: every operator takes and returns DataFrames keyed by seed_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.resolve import streaming_range
from .storage import durable

#: Seeds up to which they are broadcast to the features; more of them meet the features in a shuffle by tile.
MOST_BROADCAST_SEEDS = 100_000


def small(df: DataFrame, limit: int = MOST_BROADCAST_SEEDS) -> DataFrame:
    """df with a broadcast hint if a bounded count proves it small; otherwise the join stays with the optimizer."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def clamp_radius(seeds: DataFrame) -> DataFrame:
    r = F.col("radius")
    fine = r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf"))
    return seeds.withColumn("radius", geo.clamp(F.when(fine, r).otherwise(geo.RADIUS_DEFAULT), geo.RADIUS_MIN, geo.RADIUS_MAX))


def bounds_around(seeds: DataFrame, pad: float = 0.0) -> DataFrame:
    dlat, dlon = geo.delta_lat(F.col("radius") + pad), geo.delta_lon(F.col("radius") + pad, F.col("lat"))
    return seeds.withColumns({"west": F.col("lon") - dlon, "south": F.col("lat") - dlat, "east": F.col("lon") + dlon, "north": F.col("lat") + dlat})


def tiles_for_bounds(bounds: DataFrame, zoom: int = geo.FEATURE_ZOOM) -> DataFrame:
    """bounds exploded to the tiles x, y, z that they touch."""
    xs = F.sequence(geo.tile_x(F.col("west"), zoom), geo.tile_x(F.col("east"), zoom))
    ys = F.sequence(geo.tile_y(F.col("north"), zoom), geo.tile_y(F.col("south"), zoom))
    return bounds.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys)).withColumn("z", F.lit(zoom))


def with_seed(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """df with lon0, lat0 and radius of its seed."""
    s = seeds.select("seed_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), "radius")
    return df.join(small(s), "seed_id")


def to_local(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """x, z in metres of the columns lon, lat."""
    found = with_seed(df, seeds)
    return found.withColumns({"x": geo.local_x(F.col("lon"), F.col("lon0"), F.col("lat0")), "z": geo.local_z(F.col("lat"), F.col("lat0"))}).drop("lon0", "lat0")


def local_paths(df: DataFrame, seeds: DataFrame, column: str = "path") -> DataFrame:
    """A column of (lon, lat) arrays as arrays of (x, z)."""
    found = with_seed(df, seeds)
    made = F.transform(column, lambda p: F.struct(geo.local_x(p["lon"], F.col("lon0"), F.col("lat0")).alias("x"), geo.local_z(p["lat"], F.col("lat0")).alias("z")))
    return found.withColumn(column, made).drop("lon0", "lat0")


def from_local(df: DataFrame, seeds: DataFrame) -> DataFrame:
    found = with_seed(df, seeds)
    return found.withColumns({"lon": geo.lon_of(F.col("x"), F.col("lon0"), F.col("lat0")), "lat": geo.lat_of(F.col("z"), F.col("lat0"))}).drop("lon0", "lat0")


def seed_distance(df: DataFrame, seeds: DataFrame) -> DataFrame:
    found = with_seed(df, seeds)
    return found.withColumn("distance", geo.haversine(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))).drop("lon0", "lat0")


def world_tile(df: DataFrame, size: float = geo.WORLD_TILE) -> DataFrame:
    """tile_x, tile_z, tile ("x:z") and the tile's centre, for points x, z."""
    tx, tz = (F.floor((F.col(c) + size / 2) / size).cast("int") for c in ("x", "z"))
    named = df.withColumns({"tile_x": tx, "tile_z": tz})
    return named.withColumns({"tile": F.concat_ws(":", "tile_x", "tile_z"), "center_x": F.col("tile_x") * size, "center_z": F.col("tile_z") * size})


def touches_radius(paths: DataFrame, seeds: DataFrame, pad: float = 0.0) -> DataFrame:
    """Features of which any vertex (lon, lat) of `path` lies within radius + pad of their seed."""
    near = F.exists("path", lambda p: geo.haversine(F.col("lon0"), F.col("lat0"), p["lon"], p["lat"]) <= F.col("radius") + pad)
    return with_seed(paths, seeds).where(near).select(paths.columns)


def features_within_radius(points: DataFrame, seeds: DataFrame, pad: float = 0.0, zoom: int = geo.FEATURE_ZOOM) -> DataFrame:
    """Features (id, lon, lat) paired with every seed that they are within radius + pad of.

    Seeds become the tiles that their boxes touch; features meet them by an equi-join on the tile, and the distance
    decides. A feature lies in one tile, so no pair comes twice.
    """
    tiles = tiles_for_bounds(bounds_around(seeds, pad), zoom).select("seed_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), "radius", "x", "y")
    keyed = points.withColumns({"x": geo.tile_x(F.col("lon"), zoom), "y": geo.tile_y(F.col("lat"), zoom)})
    d = geo.haversine(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    return keyed.join(small(tiles), ["x", "y"]).withColumn("distance", d).where(F.col("distance") <= F.col("radius") + pad).drop("x", "y", "lon0", "lat0", "radius")


#: Tiles with positions up to which what lies around them is broadcast.
MOST_BROADCAST_TILES = 4_096


def visible_tiles(positions: DataFrame, tiles: DataFrame, mode: str, size: float = geo.WORLD_TILE, key: str = "event_id") -> DataFrame:
    """positions (seed_id, x, z, radius) joined with the tiles (seed_id, tile_x, tile_z) in the mode's base range.

    What lies in the bounded square around a tile is listed once for each tile that has positions, as one row; a position meets
    the row of its tile, so no pair of position and tile is shuffled.
    """
    reach = streaming_range(F.lit(mode), F.col("radius"))["base"] + size * 2**0.5 / 2
    at = world_tile(positions.select("seed_id", key, "x", "z", "radius"), size).withColumn("reach", reach).select("seed_id", key, "x", "z", "reach", "tile_x", "tile_z")
    spots = at.groupBy("seed_id", "tile_x", "tile_z").agg(F.max(F.ceil(F.col("reach") / size).cast("int")).alias("steps"))
    square = lambda c: F.explode(F.sequence(F.col(f"tile_{c}") - F.col("steps"), F.col(f"tile_{c}") + F.col("steps")))
    spread = spots.withColumn("near_x", square("x")).withColumn("near_z", square("z")).drop("steps")
    there = tiles.select("seed_id", F.col("tile_x").alias("near_x"), F.col("tile_z").alias("near_z")).distinct()
    around = durable(spread.join(there, ["seed_id", "near_x", "near_z"]).groupBy("seed_id", "tile_x", "tile_z").agg(F.collect_list(F.struct("near_x", "near_z")).alias("around")))
    met = at.join(small(around, MOST_BROADCAST_TILES), ["seed_id", "tile_x", "tile_z"]).select("seed_id", key, "x", "z", "reach", F.explode("around").alias("t"))
    dx, dz = F.col("t.near_x") * size - F.col("x"), F.col("t.near_z") * size - F.col("z")
    return met.where(F.sqrt(dx * dx + dz * dz) <= F.col("reach")).select("seed_id", F.col("t.near_x").alias("tile_x"), F.col("t.near_z").alias("tile_z"), key)
