"""Provider choice, the object manifest and what is counted and exported from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tiling import world_tile

# The manifest's layers.
LAYERS = ("terrain", "areas", "roads", "buildings", "roofs")


def prefer_source(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per seed all rows of the primary provider if it has any, else all of the fallback."""
    return primary.unionByName(fallback.join(primary.select("seed_id").distinct(), "seed_id", "left_anti"))


def source_choices(seeds: DataFrame, buildings: DataFrame, roads: DataFrame, osm: DataFrame, grid: DataFrame) -> DataFrame:
    """Per seed the warnings that the choice of providers brings, and whether there is nothing at all."""
    has = lambda df, name: df.select("seed_id").distinct().withColumn(name, F.lit(True))
    met = seeds.select("seed_id")
    for df, name in ((buildings, "b"), (roads, "r"), (osm, "o"), (grid, "t")):
        met = met.join(has(df, name), "seed_id", "left")
    gone = lambda n, text: F.when(F.col(n).isNull(), F.lit(text))
    warn = F.array_compact(F.array(gone("o", "streets and land data missing"), gone("b", "fallback buildings"), gone("r", "fallback roads"), gone("t", "flat terrain")))
    return met.select("seed_id", F.array_join(warn, "; ").alias("warnings"), F.coalesce(F.col("b"), F.col("r"), F.col("o")).isNull().alias("empty"))


def require_data(choices: DataFrame) -> DataFrame:
    """The choices, or an error where a seed has no data at all."""
    return choices.withColumn("warnings", F.when(F.col("empty"), F.raise_error(F.concat(F.lit("no map data for seed "), F.col("seed_id").cast("string"))).cast("string")).otherwise(F.col("warnings")))


def source_details(buildings: DataFrame) -> DataFrame:
    """Per seed the sorted different geometry sources, blank ones left out."""
    return buildings.groupBy("seed_id").agg(F.array_sort(F.collect_set(F.when(F.col("geometry_source") != "", F.col("geometry_source")))).alias("sources"))


def object_bounds(vertices: DataFrame) -> DataFrame:
    """min, max and centre of the vertices (seed_id, id, x, y, z) of each object."""
    box = vertices.groupBy("seed_id", "id").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return centred(box)


def centred(box: DataFrame) -> DataFrame:
    return box.withColumns({f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"})


def road_bounds(box: DataFrame, roads: DataFrame) -> DataFrame:
    """Boxes of road paths widened by half their width, a quarter of a metre high."""
    met = box.join(roads.select("seed_id", "id", "width", "kind"), ["seed_id", "id"])
    half = F.col("width") / 2
    return centred(met.withColumns({"min_x": F.col("min_x") - half, "max_x": F.col("max_x") + half, "min_z": F.col("min_z") - half, "max_z": F.col("max_z") + half, "max_y": F.col("max_y") + 0.25}))


OBJECT = ("seed_id", "object_id", "source_id", "layer", "source", "kind", *(f"{n}_{c}" for n in ("min", "max", "center") for c in "xyz"))


def building_objects(buildings: DataFrame, box: DataFrame, ground: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects of buildings and of their roofs. buildings: resolved heights and roofs; box: min/max of x and z; ground: y at
    the box's centre."""
    met = buildings.join(box, ["seed_id", "id"]).join(ground.select("seed_id", "id", "y"), ["seed_id", "id"])

    def made(layer, prefix, kind, low, high):
        return centred(met.withColumns({"min_y": low, "max_y": high})).select("seed_id", F.concat(F.lit(f"{prefix}:"), "id").alias("object_id"), F.col("id").alias("source_id"), F.lit(layer).alias("layer"), F.lit("overture").alias("source"), kind.alias("kind"), *OBJECT[6:])

    y, top = F.col("y"), F.col("y") + F.col("resolved_height")
    return made("buildings", "building", F.col("kind"), y + F.col("resolved_min_height"), top), made("roofs", "roof", F.col("roof_profile"), top - F.col("roof_rise"), top + 0.03)


def plain_objects(box: DataFrame, layer: str, prefix: str, source: str) -> DataFrame:
    """Objects of roads or areas from their boxes (with kind)."""
    return box.select("seed_id", F.concat(F.lit(f"{prefix}:"), "id").alias("object_id"), F.col("id").alias("source_id"), F.lit(layer).alias("layer"), F.lit(source).alias("source"), "kind", *OBJECT[6:])


def terrain_objects(seeds: DataFrame, summary: DataFrame) -> DataFrame:
    """One object per seed: a mesh where there is a grid summary, a flat plane elsewhere."""
    met = seeds.select("seed_id", "radius").join(summary, "seed_id", "left")
    low, high = F.coalesce("min_height", F.lit(0.0)), F.coalesce("max_height", F.lit(0.0))
    box = met.select("seed_id", F.lit("ground").alias("id"), F.when(F.col("origin").isNull(), "flat-plane").otherwise("elevation-mesh").alias("kind"), (-F.col("radius")).alias("min_x"), F.col("radius").alias("max_x"), low.alias("min_y"), high.alias("max_y"), (-F.col("radius")).alias("min_z"), F.col("radius").alias("max_z"))
    return plain_objects(centred(box), "terrain", "terrain", "elevation")


def manifest(*layers: DataFrame) -> DataFrame:
    """The layers' objects together, each with the tile of its centre (terrain has none)."""
    out = layers[0].select(*OBJECT)
    for more in layers[1:]:
        out = out.unionByName(more.select(*OBJECT))
    tiled = world_tile(out.withColumns({"x": F.col("center_x"), "z": F.col("center_z"), "cx": F.col("center_x"), "cz": F.col("center_z")}))
    return tiled.withColumn("tile", F.when(F.col("layer") != "terrain", F.col("tile"))).select(*OBJECT[:-3], F.col("cx").alias("center_x"), "center_y", F.col("cz").alias("center_z"), "tile")


def layer_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("seed_id").pivot("layer", list(LAYERS)).count().fillna(0, list(LAYERS))


def colliders(objects: DataFrame) -> DataFrame:
    """A box for each building: sides of at least a quarter of a metre, and its centre."""
    side = lambda c: F.greatest(F.lit(0.25), F.col(f"max_{c}") - F.col(f"min_{c}"))
    return objects.where("layer = 'buildings'").select("seed_id", "object_id", side("x").alias("width"), side("y").alias("height"), side("z").alias("depth"), "center_x", "center_y", "center_z")


def world_stats(seeds: DataFrame, buildings: DataFrame, roads: DataFrame, nodes: DataFrame, edges: DataFrame, objects: DataFrame, summary: DataFrame) -> DataFrame:
    """One row of counters per seed; every source is aggregated before the joins."""
    q = lambda k: F.count_if(F.col("height_quality") == k)
    b = buildings.groupBy("seed_id").agg(F.count(F.lit(1)).alias("buildings"), q("provided").alias("provided_heights"), q("levels").alias("level_heights"), q("inferred").alias("inferred_heights"), F.count_if(F.col("roof_profile") != "flat").alias("shaped_roofs"))
    o = objects.groupBy("seed_id").agg(F.count(F.lit(1)).alias("semantic_objects"), F.countDistinct("tile").alias("tiles"))
    parts = [
        b, o, roads.groupBy("seed_id").agg(F.count(F.lit(1)).alias("roads")), nodes.groupBy("seed_id").agg(F.count(F.lit(1)).alias("road_nodes")),
        edges.groupBy("seed_id").agg(F.count(F.lit(1)).alias("road_edges"), F.floor(F.sum("length") + 0.5).cast("long").alias("drivable_meters")), summary.select("seed_id", (F.col("max_height") - F.col("min_height")).alias("relief")),
    ]
    out = seeds.select("seed_id")
    for p in parts:
        out = out.join(p, "seed_id", "left")
    return out.fillna(0)


def quality_grade(stats: DataFrame) -> DataFrame:
    """stats with known, the share of buildings whose height is known, and its grade; demo and detailed worlds have their own."""
    known = (F.col("provided_heights") + F.col("level_heights")) / F.greatest(F.col("buildings"), F.lit(1))
    grade = F.when(known > 0.65, "STRONG").when(known > 0.25, "MIXED").otherwise("INFERRED")
    if "is_demo" in stats.columns:
        grade = F.when(F.col("is_demo"), "DEMO").when(F.col("lod2") > 0, "PLATEAU LOD2").when(F.col("lod1") > 0, "PLATEAU LOD1").otherwise(grade)
    return stats.withColumn("known", known).withColumn("grade", grade)


def tile_buckets(parts: DataFrame) -> DataFrame:
    """parts (seed_id, tile, kind, id) by tile and kind: different features and geometries."""
    return parts.groupBy("seed_id", "tile", "kind").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count(F.lit(1)).alias("n_parts"))


def world_metadata(worlds: DataFrame, include_origin: bool = False) -> DataFrame:
    """Metadata rows; the origin is null unless it is asked for."""
    origin = lambda c: F.when(F.lit(include_origin), F.col(c)).alias(f"origin_{c}")
    rest = [c for c in worlds.columns if c not in ("lon", "lat")]
    return worlds.select(*rest, origin("lon"), origin("lat"), F.lit(include_origin).alias("exact_origin_included"))


def privacy_safe(df: DataFrame, include_origin: bool = False, origin: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    out = df if include_origin else df.drop(*origin)
    return out.withColumn("exact_origin_included", F.lit(include_origin))


def attribution_document(attributions: DataFrame, worlds: DataFrame) -> DataFrame:
    """Per world a bullet list of its sources (seed_id, rank, label, license) in order, a fixed line where there are none, and
    the geometry sources behind it."""
    lines = attributions.dropDuplicates(["seed_id", "label"]).groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "label", F.lit(" - "), "license").alias("line")))).alias("l"))
    met = worlds.join(lines, "seed_id", "left")
    text = F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("- Synthetic demonstration data."))
    more = F.when(F.size(F.coalesce(F.col("sources"), F.array().cast("array<string>"))) > 0, F.concat(F.lit("\nGeometry source details: "), F.array_join("sources", ", "), F.lit("."))).otherwise("")
    return met.select("seed_id", F.concat(text, more).alias("document"))


def compact_properties(df: DataFrame, column: str = "properties") -> DataFrame:
    return df.withColumn(column, F.map_filter(column, lambda k, v: v.isNotNull()))


def _write_by_seed(rows: DataFrame, path: str) -> None:
    """Rows as a table by seed; only the seeds in them are replaced, so the same write again leaves the same."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seed_id").parquet(path)


def _write_parts(parts: dict[str, DataFrame], path: str) -> None:
    """The parts' rows, and last a header of how many each seed has: a seed counts as written when its header is."""
    for name, rows in parts.items():
        _write_by_seed(rows, f"{path}/{name}")
    spark = next(iter(parts.values())).sparkSession
    header = None
    for name in parts:
        n = spark.read.parquet(f"{path}/{name}").join(parts[name].select("seed_id").distinct(), "seed_id", "left_semi").groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        header = n if header is None else header.unionByName(n)
    _write_by_seed(header, f"{path}/header")


def _read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of the seeds that have a header; those of a write that has not ended are left out, and a table that has not what
    its header says raises an error."""
    header = spark.read.parquet(f"{path}/header").where(F.col("part") == part).select("seed_id", "n")
    rows = spark.read.parquet(f"{path}/{part}").join(header.select("seed_id"), "seed_id", "left_semi")
    found = rows.groupBy("seed_id").agg(F.count(F.lit(1)).alias("found"))
    wrong = header.join(found, "seed_id", "left").where("coalesce(found, 0) <> n").limit(1).count()
    if wrong:
        raise ValueError(f"{part} of {path} does not hold the rows that its header names")
    return rows


def write_manifest(objects: DataFrame, path: str) -> None:
    """The manifest partitioned by seed; rows of one seed and tile stand together."""
    _write_parts({"objects": objects.repartition("seed_id", "tile").sortWithinPartitions("seed_id", "tile")}, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _read_part(spark, path, "objects")


def write_road_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges, each partitioned by seed."""
    _write_parts({"nodes": nodes.repartition("seed_id"), "edges": edges.repartition("seed_id", "road")}, path)


def read_road_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read_part(spark, path, "nodes"), _read_part(spark, path, "edges")
