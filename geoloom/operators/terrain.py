"""Elevation: grids as long tables (seed_id, row, col, height), sampling, meshes, slopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.resolve import grid_size, mesh_profile
from .storage import durable
from .tiling import from_local, small


def grid_points(seeds: DataFrame, n: Column | int) -> DataFrame:
    """The places of an n by n grid over each seed's square: seed_id, radius, row, col, x, z. n may differ by seed."""
    n = F.lit(n) if isinstance(n, int) else n
    at = lambda c: -F.col("radius") + F.col(c) * (2 * F.col("radius") / (F.col("__n") - 1))
    each = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    spread = seeds.select("seed_id", "radius", n.cast("int").alias("__n")).withColumn("row", each).withColumn("col", each)
    return spread.withColumns({"x": at("col"), "z": at("row")}).drop("__n")


def terrain_grid(seeds: DataFrame, pixels: DataFrame, zoom: int = geo.FEATURE_ZOOM, size: int = 256) -> DataFrame:
    """Heights above the middle on each seed's grid, 65 to 257 samples a side by its radius, from elevation tiles."""
    placed = from_local(grid_points(seeds, grid_size(F.col("radius"))), seeds).select("seed_id", "row", "col", "x", "z", "lon", "lat")
    return rebased(sample_mosaic(placed, pixels, zoom, size).withColumnRenamed("elevation", "height"))


def demo_elevation(seeds: DataFrame, n: int = 33) -> DataFrame:
    """A synthetic n by n grid over each seed's square: row, col, x, z, height."""
    placed = grid_points(seeds, n)
    x, z = F.col("x"), F.col("z")
    return placed.withColumn("height", F.sin(x / 230) * 3.2 + F.cos(z / 280) * 2.4 + F.sin((x + z) / 95) * 0.8 - 2.4)


def grid_header(grid: DataFrame) -> DataFrame:
    """One row per seed: rows, columns and the extent of a grid (seed_id, row, col, x, z, height)."""
    return grid.groupBy("seed_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def elevation_at(points: DataFrame, grid: DataFrame, header: DataFrame | None = None, key: str = "point") -> DataFrame:
    """points (seed_id, key, x, z) with `y`, bilinear in the grid and clamped to its edge; 0 without a grid.

    Each point meets its four grid neighbours by an equi-join on (seed_id, row, col) of a table that holds every cell's
    four corners, so the points are shuffled once.
    """
    head = grid_header(grid) if header is None else header
    w = Window.partitionBy("seed_id", "row").orderBy("col")
    right = grid.select("seed_id", "row", "col", F.col("height").alias("h00"), F.lead("height").over(w).alias("h01"))
    v = Window.partitionBy("seed_id", "col").orderBy("row")
    cells = right.withColumns({"h10": F.lead("h00").over(v), "h11": F.lead("h01").over(v)})
    share = lambda c, n, a, b: geo.clamp((F.col(c) - F.col(a)) / (F.col(b) - F.col(a)), 0.0, 1.0) * (F.col(n) - 1)
    placed = points.join(head.where("n_rows >= 2 and n_cols >= 2"), "seed_id", "left").withColumns({"gx": share("x", "n_cols", "min_x", "max_x"), "gz": share("z", "n_rows", "min_z", "max_z")})
    placed = placed.withColumns({"col": F.least(F.floor("gx").cast("int"), F.col("n_cols") - 2), "row": F.least(F.floor("gz").cast("int"), F.col("n_rows") - 2)})
    met = placed.join(cells, ["seed_id", "row", "col"], "left").withColumns({"tx": F.col("gx") - F.col("col"), "tz": F.col("gz") - F.col("row")})
    top = F.col("h00") + (F.col("h01") - F.col("h00")) * F.col("tx")
    low = F.col("h10") + (F.col("h11") - F.col("h10")) * F.col("tx")
    return met.withColumn("y", F.coalesce(top + (low - top) * F.col("tz"), F.lit(0.0))).select(*points.columns, "y")


def lay(rows: DataFrame, grid: DataFrame, spots: dict[str, tuple[str, str]], lift: float = 0.0) -> DataFrame:
    """rows with a height `lift` above the grid for each spot: the height's name and the columns that say where it is."""
    head = grid_header(grid)
    for name, (x, z) in spots.items():
        points = rows.select("seed_id", F.struct(*rows.columns).alias("__row"), F.col(x).alias("x"), F.col(z).alias("z"))
        rows = elevation_at(points, grid, head).select("__row.*", (F.col("y") + lift).alias(name))
    return rows


def grid_summary(grid: DataFrame) -> DataFrame:
    """Per seed the middle sample's elevation (origin) and the range above it."""
    head = grid_header(grid).select("seed_id", F.floor(F.col("n_rows") / 2).cast("int").alias("row"), F.floor(F.col("n_cols") / 2).cast("int").alias("col"))
    origin = grid.join(head, ["seed_id", "row", "col"]).select("seed_id", F.col("height").alias("origin"))
    span = grid.groupBy("seed_id").agg(F.min("height").alias("low"), F.max("height").alias("high"), F.count(F.lit(1)).alias("n_samples"))
    return span.join(origin, "seed_id").select("seed_id", "n_samples", "origin", (F.col("low") - F.col("origin")).alias("min_height"), (F.col("high") - F.col("origin")).alias("max_height"))


def rebased(grid: DataFrame) -> DataFrame:
    """The grid with heights above the origin."""
    return grid.join(grid_summary(grid).select("seed_id", "origin"), "seed_id").withColumn("height", F.col("height") - F.col("origin")).drop("origin")


def sample_mosaic(points: DataFrame, pixels: DataFrame, zoom: int = geo.FEATURE_ZOOM, size: int = 256, key: str = "point") -> DataFrame:
    """Elevation at lon, lat from tile pixels (tile_x, tile_y, px, py, elevation): bilinear inside the tile, clamped at its
    edge. A point whose tile is missing gets null and `missing`."""
    n = float(1 << zoom)
    gx = (F.col("lon") + 180) / 360 * n * size
    gy = (1 - F.asinh(F.tan(geo.clamp(F.col("lat"), -geo.MAX_LATITUDE, geo.MAX_LATITUDE) * geo.DEG)) / math.pi) / 2 * n * size
    placed = points.withColumns({"gx": gx, "gy": gy}).withColumns({"tile_x": F.floor(F.col("gx") / size).cast("int"), "tile_y": F.floor(F.col("gy") / size).cast("int")})
    placed = placed.withColumns({"fx": geo.clamp(F.col("gx") - F.col("tile_x") * size, 0.0, size - 1.0), "fy": geo.clamp(F.col("gy") - F.col("tile_y") * size, 0.0, size - 1.0)})
    placed = placed.withColumns({"x0": F.floor("fx").cast("int"), "y0": F.floor("fy").cast("int")})
    # each pixel with those to its right, below and across, so a point meets one row; the tile's last ones stand for the next
    following = lambda c, name, w, old: F.when(F.col(c) == size - 1, F.col(old)).when(F.lead(c).over(w) == F.col(c) + 1, F.lead(old).over(w)).alias(name)
    along, down = Window.partitionBy("tile_x", "tile_y", "py").orderBy("px"), Window.partitionBy("tile_x", "tile_y", "px").orderBy("py")
    rows = pixels.select("tile_x", "tile_y", "px", "py", F.col("elevation").alias("h00"), following("px", "h10", along, "elevation"))
    cells = durable(rows.select("tile_x", "tile_y", F.col("px").alias("x0"), F.col("py").alias("y0"), "h00", "h10", following("py", "h01", down, "h00"), following("py", "h11", down, "h10")))
    met = placed.join(small(cells), ["tile_x", "tile_y", "x0", "y0"], "left").withColumns({"wx": F.col("fx") - F.col("x0"), "wy": F.col("fy") - F.col("y0")})
    wx, wy = F.col("wx"), F.col("wy")
    total = (1 - wx) * (1 - wy) * F.col("h00") + wx * (1 - wy) * F.col("h10") + (1 - wx) * wy * F.col("h01") + wx * wy * F.col("h11")
    return met.select(*points.columns, total.alias("elevation")).withColumn("missing", F.col("elevation").isNull())


def sample_tin(points: DataFrame, triangles: DataFrame, key: str = "point", size: float = 28.0) -> DataFrame:
    """y of points on triangles (seed_id, tri, ax, ay, az, bx, by, bz, cx, cy, cz): of those that hold the point the first, by
    barycentric weights; else the nearest vertex in the point's cell, then in the ring around it; else null."""
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    # the tolerance of the weights widens a triangle past its corners, so it stands in the cells of the wider one
    wide = lambda a, b, c: [F.col(p) + (2 * F.col(p) - F.col(q) - F.col(r)) * 0.000801 for p, q, r in ((a, b, c), (b, a, c), (c, a, b))]
    span = lambda a, b, c: F.sequence(F.floor(F.least(*wide(a, b, c)) / size).cast("long"), F.floor(F.greatest(*wide(a, b, c)) / size).cast("long"))
    keyed = points.select("seed_id", key, "x", "z").withColumns({"kx": cell("x"), "kz": cell("z")})
    spread = triangles.withColumn("kx", F.explode(span("ax", "bx", "cx"))).withColumn("kz", F.explode(span("az", "bz", "cz")))
    x, z, ax, az, bx, bz, cx, cz = (F.col(n) for n in ("x", "z", "ax", "az", "bx", "bz", "cx", "cz"))
    det = (bz - cz) * (ax - cx) + (cx - bx) * (az - cz)
    safe = F.when(F.abs(det) >= 1e-8, det)
    u, v = ((bz - cz) * (x - cx) + (cx - bx) * (z - cz)) / safe, ((cz - az) * (x - cx) + (ax - cx) * (z - cz)) / safe
    met = keyed.join(spread, ["seed_id", "kx", "kz"]).withColumns({"u": u, "v": v}).withColumn("w", 1 - F.col("u") - F.col("v"))
    hit = met.where("u >= -0.0008 and v >= -0.0008 and w >= -0.0008").groupBy("seed_id", key).agg(F.min_by(F.col("u") * F.col("ay") + F.col("v") * F.col("by") + F.col("w") * F.col("cy"), "tri").alias("y"))
    left = keyed.join(hit, ["seed_id", key], "left_anti")
    corner = triangles.select("seed_id", "tri", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"{c}x").alias("vx"), F.col(f"{c}y").alias("vy"), F.col(f"{c}z").alias("vz")) for i, c in enumerate("abc")])).alias("q")).select("seed_id", "tri", "q.*")
    corner = corner.withColumns({"nx": cell("vx"), "nz": cell("vz")})
    around = left.withColumn("nx", F.explode(F.sequence(F.col("kx") - 1, F.col("kx") + 1))).withColumn("nz", F.explode(F.sequence(F.col("kz") - 1, F.col("kz") + 1)))
    d = F.sqrt((F.col("vx") - x) ** 2 + (F.col("vz") - z) ** 2)
    near = around.join(corner, ["seed_id", "nx", "nz"]).withColumn("ring", F.greatest(F.abs(F.col("nx") - F.col("kx")), F.abs(F.col("nz") - F.col("kz"))))
    near = near.groupBy("seed_id", key).agg(F.min_by("vy", F.struct(F.col("ring"), d.alias("d"), F.col("tri"), F.col("i"))).alias("y"))
    return points.join(hit.withColumn("how", F.lit("inside")).unionByName(near.withColumn("how", F.lit("vertex"))), ["seed_id", key], "left").withColumn("how", F.coalesce("how", F.lit("missed")))


def draped_strips(strips: DataFrame, triangles: DataFrame, lift: float = 0.14) -> DataFrame:
    """strips (seed_id, strip, ax, az, bx, bz) cut into clamp(ceil(length / 5.5), 1, 64) spans and laid on the triangles:
    per strip its samples, misses and the range of its heights."""
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("bz") - F.col("az")) ** 2)
    n = geo.clamp(F.ceil(length / 5.5).cast("int"), 1, 64)
    cut = strips.withColumn("spans", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("spans"))))
    share = F.col("k") / F.col("spans")
    points = cut.select("seed_id", "strip", "spans", "k", F.concat_ws(":", "strip", "k").alias("point"), (F.col("ax") + (F.col("bx") - F.col("ax")) * share).alias("x"), (F.col("az") + (F.col("bz") - F.col("az")) * share).alias("z"))
    laid = sample_tin(points, triangles)
    return laid.groupBy("seed_id", "strip", "spans").agg(F.count(F.lit(1)).alias("n_vertices"), F.count_if(F.col("how") == "missed").alias("n_missed"), F.min(F.col("y") + lift).alias("min_y"), F.max(F.col("y") + lift).alias("max_y"))


def radial_terrain(seeds: DataFrame, sectors: int | None = None, rings: int | None = None) -> DataFrame:
    """The vertices of a radial mesh: the centre (index 0), then ring by ring: seed_id, point, ring, sector, x, z. Sectors and
    rings are given, or follow from the radius and the spacing of its grid."""
    profile = mesh_profile(2 * F.col("radius") / (grid_size(F.col("radius")) - 1), F.col("radius"))
    given = lambda n, name: (profile[name] if n is None else F.lit(n)).alias(name)
    s = seeds.select("seed_id", "radius", given(sectors, "sectors"), given(rings, "rings"))
    spread = s.withColumn("ring", F.explode(F.sequence(F.lit(1), F.col("rings")))).withColumn("sector", F.explode(F.sequence(F.lit(0), F.col("sectors") - 1)))
    angle, r = F.col("sector") * (F.lit(2 * math.pi) / F.col("sectors")), F.col("radius") * F.col("ring") / F.col("rings")
    outer = spread.select("seed_id", (1 + (F.col("ring") - 1) * F.col("sectors") + F.col("sector")).cast("int").alias("point"), "ring", "sector", (F.cos(angle) * r).alias("x"), (F.sin(angle) * r).alias("z"))
    centre = s.select("seed_id", F.lit(0).alias("point"), F.lit(0).alias("ring"), F.lit(0).alias("sector"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))
    return centre.unionByName(outer)


def terrain_triangles(meshes: DataFrame, stride: int = 1) -> DataFrame:
    """meshes (sectors, rings) exploded to the triangles a, b, c of their radial mesh, every stride-th ring and sector; the
    last ring always stays."""
    kept = F.array_distinct(F.concat(F.sequence(F.lit(stride), F.col("rings"), F.lit(stride)), F.array(F.col("rings"))))
    marks = meshes.withColumn("kept", kept).withColumn("sector", F.explode(F.sequence(F.lit(0), F.col("sectors") - stride, F.lit(stride))))
    at = lambda ring, sector: F.lit(1) + (ring - 1) * F.col("sectors") + sector % F.col("sectors")
    nxt = F.col("sector") + stride
    first = F.array(F.struct(F.lit(0).alias("a"), at(F.get("kept", 0), nxt).alias("b"), at(F.get("kept", 0), F.col("sector")).alias("c")))
    inner = F.flatten(F.transform(F.slice("kept", 2, F.size("kept") - 1), lambda ring, i: F.array(
        F.struct(at(F.get("kept", i), F.col("sector")).alias("a"), at(ring, nxt).alias("b"), at(ring, F.col("sector")).alias("c")),
        F.struct(at(F.get("kept", i), F.col("sector")).alias("a"), at(F.get("kept", i), nxt).alias("b"), at(ring, nxt).alias("c")))))
    return marks.withColumn("t", F.explode(F.concat(first, inner))).select(*meshes.columns, "t.a", "t.b", "t.c")


def vertex_slope(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Slopes at the vertices (seed_id, point, x, y, z) of triangles (seed_id, a, b, c) from area-weighted normals: degrees,
    the ratio to 48 degrees, its band, and the height above the lowest vertex as a share of the relief."""
    v = lambda n: vertices.select("seed_id", F.col("point").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    t = triangles.join(v("a"), ["seed_id", "a"]).join(v("b"), ["seed_id", "b"]).join(v("c"), ["seed_id", "c"])
    d = {f"{n}{c}": F.col(f"{n}{c}") - F.col(f"a{c}") for n in "bc" for c in "xyz"}
    n = {"nx": d["by"] * d["cz"] - d["bz"] * d["cy"], "ny": d["bz"] * d["cx"] - d["bx"] * d["cz"], "nz": d["bx"] * d["cy"] - d["by"] * d["cx"]}
    each = t.select("seed_id", F.explode(F.array("a", "b", "c")).alias("point"), *[e.alias(k) for k, e in n.items()])
    sums = each.groupBy("seed_id", "point").agg(*[F.sum(k).alias(k) for k in n])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    slope = F.degrees(F.acos(geo.clamp(F.abs(F.col("ny")) / F.when(size > 0, size), 0.0, 1.0)))
    span = vertices.groupBy("seed_id").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    out = vertices.select("seed_id", "point", "y").join(sums.withColumn("slope", slope), ["seed_id", "point"]).join(span, "seed_id")
    ratio = geo.clamp(F.col("slope") / 48, 0.0, 1.0)
    band = F.when(ratio < 0.34, "cool-moderate").when(ratio < 0.7, "moderate-steep").otherwise("steep-cliff")
    return out.select("seed_id", "point", "slope", ratio.alias("ratio"), band.alias("band"), ((F.col("y") - F.col("low")) / F.greatest(F.lit(1.0), F.col("high") - F.col("low"))).alias("relative"))


def ground_pose(positions: DataFrame, grid: DataFrame, wheelbase: float = 3.8, track: float = 2.45, key: str = "event_id") -> DataFrame:
    """Pitch, roll and ground height of vehicles at x, z with a heading, from five elevation samples."""
    s, c = F.sin("heading"), F.cos("heading")
    offs = {"center": (0.0, 0.0), "front": (wheelbase / 2, 0.0), "rear": (-wheelbase / 2, 0.0), "left": (0.0, -track / 2), "right": (0.0, track / 2)}
    spots = F.array(*[F.struct(F.lit(n).alias("spot"), (F.col("x") + s * a + c * b).alias("px"), (F.col("z") + c * a - s * b).alias("pz")) for n, (a, b) in offs.items()])
    five = positions.select("seed_id", key, F.explode(spots).alias("p")).select("seed_id", key, "p.spot", F.col("p.px").alias("x"), F.col("p.pz").alias("z"))
    laid = elevation_at(five, grid).groupBy("seed_id", key).agg(*[F.max(F.when(F.col("spot") == n, F.col("y"))).alias(n) for n in offs])
    mean = (F.col("front") + F.col("rear") + F.col("left") + F.col("right")) / 4
    pitch = geo.clamp(F.atan2(F.col("front") - F.col("rear"), F.lit(wheelbase)), -0.62, 0.62)
    roll = geo.clamp(F.atan2(F.col("right") - F.col("left"), F.lit(track)), -0.48, 0.48)
    return laid.select("seed_id", key, pitch.alias("pitch"), roll.alias("roll"), F.greatest(F.col("center"), mean).alias("ground"))
