"""Readers of feature files: buildings, transportation, tagged elements, elevation tiles, CityGML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import once
from ..functions.resolve import terrarium
from ..operators.tiling import bounds_around, small, tiles_for_bounds, touches_radius, with_seed

ELEMENTS = "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,role:string,ref:long,geometry:array<struct<lat:double,lon:double>>>>"
POSITIONS = "struct<posList:string>"
SURFACE = "struct<lod2MultiSurface:struct<MultiSurface:struct<surfaceMember:array<struct<Polygon:struct<exterior:struct<LinearRing:struct<posList:string>>>>>>>>"
BUILDING_XML = f"_id string, name string, boundedBy array<struct<GroundSurface:{SURFACE},WallSurface:{SURFACE},RoofSurface:{SURFACE},ClosureSurface:{SURFACE}>>, lod1Solid struct<Solid:struct<exterior:struct<CompositeSurface:struct<surfaceMember:array<struct<Polygon:struct<exterior:struct<LinearRing:struct<posList:string>>>>>>>>>"


def _near_tiles(table: DataFrame, seeds: DataFrame, pad: float) -> DataFrame:
    """Rows of a table partitioned by tile_x, tile_y that stand in a tile of a seed's box, with the seed. The tiles are known when
    the scan begins, so only their files are read."""
    # all tiles pass; the optimizer prunes by a side that has a condition
    tiles = tiles_for_bounds(bounds_around(seeds, pad)).select("seed_id", F.col("x").alias("tile_x"), F.col("y").alias("tile_y")).where("tile_x >= 0")
    return table.join(small(tiles), ["tile_x", "tile_y"])


def read_buildings(spark: SparkSession, path: str, seeds: DataFrame) -> DataFrame:
    """Building features near each seed from Parquet partitioned by tile (tile_x, tile_y); ids and names by their aliases.

    Partition pruning reads the seeds' tiles only; a feature stays if an outer vertex lies within radius + 80 m.
    """
    raw = spark.read.parquet(path)
    met = _near_tiles(raw, seeds, 80.0)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None))
    id_ = F.coalesce(first("id", "@id"), F.concat_ws(":", "tile_x", "tile_y", "ordinal"))
    made = met.select("seed_id", id_.alias("id"), first("name", "@name").alias("name"), "height", "levels", "kind", F.col("ring").alias("path"))
    return touches_radius(made, seeds, 80.0).withColumnRenamed("path", "ring")


def read_transportation(spark: SparkSession, segments: str, connectors: str, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Road segments (subtype road) within radius + 140 m and connectors within radius + 260 m of each seed."""
    roads = touches_radius(_near_tiles(spark.read.parquet(segments).where("subtype = 'road'"), seeds, 180.0), seeds, 140.0)
    from ..functions.geo import haversine

    near = with_seed(_near_tiles(spark.read.parquet(connectors), seeds, 260.0), seeds)
    near = near.where(haversine(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")) <= F.col("radius") + 260.0).drop("lon0", "lat0", "radius")
    return roads.drop("tile_x", "tile_y"), near.drop("tile_x", "tile_y")


def read_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Tagged elements from JSON lines, those that a layer can use."""
    from ..operators.osm import select_tagged

    return select_tagged(spark.read.schema(ELEMENTS).json(path))


def read_elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of elevation tiles named z/x/y.png: tile_z, tile_x, tile_y, px, py, elevation.

    The image reader hands out rows of B, G, R bytes; each pixel is cut from them in the JVM.
    """
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    name = lambda k: F.regexp_extract(F.col("image.origin"), r"(\d+)/(\d+)/(\d+)\.png$", k).cast("int")
    rows = images.select(name(1).alias("tile_z"), name(2).alias("tile_x"), name(3).alias("tile_y"), "image.width", "image.nChannels", "image.data", F.explode(F.sequence(F.lit(0), F.col("image.height") - 1)).alias("py"))
    cells = rows.withColumn("px", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    start = (F.col("py") * F.col("width") + F.col("px")) * F.col("nChannels")
    byte = lambda k: F.conv(F.hex(F.substring("data", start + k + 1, F.lit(1))), 16, 10).cast("int")
    return cells.select("tile_z", "tile_x", "tile_y", "px", "py", terrarium(byte(2), byte(1), byte(0)).alias("elevation"))


def position_list(text: Column, dim: int = 0) -> Column:
    """array<(lon, lat, elevation)> of a list of numbers: latitude first where that fits, pairs out of range left out, the
    repeated last vertex dropped from more than three."""
    # each step is bound to a variable, so it is worked out once for a text and not again for each of its vertices
    numbers = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda s: s.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    return once(numbers, lambda n: once(F.filter(_vertices(n, dim), lambda v: (F.abs(v["lat"]) <= 90) & (F.abs(v["lon"]) <= 180)), _open_ring))


def _vertices(numbers: Column, dim: int) -> Column:
    d = F.lit(dim) if dim in (2, 3) else F.when(F.size(numbers) % 3 == 0, 3).otherwise(2)
    n = F.floor(F.size(numbers) / d).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: _vertex(F.get(numbers, i * d), F.get(numbers, i * d + 1), F.when(d == 3, F.get(numbers, i * d + 2)).otherwise(0.0)))
    return F.when(n > 0, made).otherwise(F.array())


def _open_ring(kept: Column) -> Column:
    """Vertices without the last of more than three if it repeats the first."""
    a, b = F.get(kept, 0), F.try_element_at(kept, F.lit(-1))
    same = (F.abs(a["lon"] - b["lon"]) < 1e-10) & (F.abs(a["lat"] - b["lat"]) < 1e-10) & (F.abs(a["elevation"] - b["elevation"]) < 1e-4)
    return F.when((F.size(kept) > 3) & same, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def _vertex(first: Column, second: Column, elevation: Column) -> Column:
    lat_first = (F.abs(first) <= 90) & (F.abs(second) <= 180)
    return F.struct(F.when(lat_first, second).otherwise(first).alias("lon"), F.when(lat_first, first).otherwise(second).alias("lat"), elevation.alias("elevation"))


def read_citygml(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per Building of CityGML files: id, name, lod (2 if any thematic surface is given) and `surfaces`
    (kind, vertices). With `lines`, each line of a file is a building, so a large file is read by many tasks."""
    raw = spark.read.format("xml").option("rowTag", "Building").option("ignoreNamespace", "true").option("multiLine", str(not lines).lower()).schema(BUILDING_XML).load(path)
    kinds = {"ground": "GroundSurface", "wall": "WallSurface", "roof": "RoofSurface", "closure": "ClosureSurface"}
    given = lambda m: m["Polygon"]["exterior"]["LinearRing"]["posList"]
    members = lambda kind, list_: F.transform(F.filter(list_, lambda m: given(m).isNotNull()), lambda m: F.struct(F.lit(kind).alias("kind"), given(m).alias("text")))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    themed = F.flatten(F.transform(F.coalesce("boundedBy", F.array().cast(raw.schema["boundedBy"].dataType)), lambda b: F.concat(*[F.coalesce(members(k, b[e]["lod2MultiSurface"]["MultiSurface"]["surfaceMember"]), none) for k, e in kinds.items()])))
    plain = F.coalesce(members("other", F.col("lod1Solid.Solid.exterior.CompositeSurface.surfaceMember")), none)
    # the texts of positions become columns before they are read, once
    texts = raw.select(F.col("_id").alias("id"), "name", themed.alias("themed"), plain.alias("plain")).withColumn("lod", F.when(F.size("themed") > 0, 2).otherwise(1))
    texts = texts.select("id", "name", "lod", F.when(F.col("lod") == 2, F.col("themed")).otherwise(F.col("plain")).alias("texts"))
    return texts.select("id", "name", "lod", F.transform("texts", lambda s: F.struct(s["kind"].alias("kind"), position_list(s["text"], 3).alias("vertices"))).alias("surfaces"))


def dedupe_surfaces(surfaces: DataFrame) -> DataFrame:
    """surfaces (building, ordinal, kind, vertices) less those of a kind and vertices (7 and 2 decimals) that came before."""
    sign = F.array_join(F.transform("vertices", lambda v: F.format_string("%.7f,%.7f,%.2f", v["lon"], v["lat"], v["elevation"])), ";")
    w = Window.partitionBy("building", "kind", "sign").orderBy("ordinal")
    return surfaces.withColumn("sign", sign).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "sign")


def footprint_surfaces(surfaces: DataFrame) -> DataFrame:
    """The ground surfaces of each building; without any, the level ones (range up to 0.75 m) near the lowest (0.4 m)."""
    elev = F.transform("vertices", lambda v: v["elevation"])
    mean = F.aggregate(elev, F.lit(0.0), lambda s, e: s + e) / F.greatest(F.size(elev), F.lit(1))
    made = surfaces.withColumns({"mean": mean, "level": F.array_max(elev) - F.array_min(elev) <= 0.75})
    w = Window.partitionBy("building")
    made = made.withColumn("grounds", F.count_if(F.col("kind") == "ground").over(w)).withColumn("lowest", F.min(F.when(F.col("level"), F.col("mean"))).over(w))
    return made.where(F.when(F.col("grounds") > 0, F.col("kind") == "ground").otherwise(F.col("level") & (F.col("mean") <= F.col("lowest") + 0.4))).drop("mean", "level", "grounds", "lowest")


def citygml_buildings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buildings, surfaces) of read_citygml(): buildings with their elevation range, height, number of surfaces and footprint
    polygons, those without a footprint left out; surfaces without repeats."""
    flat = rows.select(F.col("id").alias("building"), "name", "lod", F.posexplode("surfaces").alias("ordinal", "s")).select("building", "name", "lod", "ordinal", "s.kind", "s.vertices").where(F.size("vertices") >= 3)
    surfaces = dedupe_surfaces(flat)
    low = F.array_min(F.transform("vertices", lambda v: v["elevation"]))
    high = F.array_max(F.transform("vertices", lambda v: v["elevation"]))
    span = surfaces.groupBy("building", "name", "lod").agg(F.min(low).alias("min_elevation"), F.max(high).alias("max_elevation"), F.count(F.lit(1)).alias("n_surfaces"))
    foot = footprint_surfaces(surfaces).groupBy("building").agg(F.count(F.lit(1)).alias("n_footprints"), F.array_sort(F.collect_list(F.struct("ordinal", "vertices"))).alias("f"))
    made = span.join(foot, "building").withColumn("polygons", F.transform("f", lambda x: x["vertices"])).drop("f")
    height = F.greatest(F.lit(1.0), F.col("max_elevation") - F.col("min_elevation"))
    return made.withColumns({"height": height, "roof_shape": F.when(F.col("lod") == 2, "lod2").otherwise("flat")}), surfaces


def citygml_summary(parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: the lowest elevation, buildings by level of detail, and those left out."""
    a = kept.agg(F.min("min_elevation").alias("base_elevation"), F.count_if(F.col("lod") == 1).alias("lod1"), F.count_if(F.col("lod") == 2).alias("lod2"), F.count(F.lit(1)).alias("kept"))
    b = parsed.agg(F.count(F.lit(1)).alias("parsed"))
    return a.join(F.broadcast(b)).withColumn("skipped", F.col("parsed") - F.col("kept")).drop("parsed", "kept")


def extent_and_radius(vertices: DataFrame) -> DataFrame:
    """Per file of vertices (file, x, z in metres from any origin): the middle of the envelope and the radius that holds all,
    rounded up to 50 m within [100, 1000]."""
    box = vertices.groupBy("file").agg(((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("z") + F.max("z")) / 2).alias("cz"))
    far = vertices.join(box, "file").groupBy("file", "cx", "cz").agg(F.max(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2)).alias("far"))
    return far.withColumn("radius", F.greatest(F.lit(100.0), F.least(F.lit(1000.0), F.ceil(F.col("far") / 50) * 50.0)))
