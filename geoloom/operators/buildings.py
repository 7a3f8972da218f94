"""Buildings: fragments, heights, roofs, rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.resolve import building_height, roof


def resolve_heights(buildings: DataFrame) -> DataFrame:
    h = building_height(F.col("id"), F.col("height"), F.col("min_height"), F.col("levels"), F.col("kind"))
    return buildings.withColumn("__h", h).withColumns({"resolved_height": F.col("__h.height"), "resolved_min_height": F.col("__h.min_height"), "height_quality": F.col("__h.quality")}).drop("__h")


def resolve_roofs(buildings: DataFrame) -> DataFrame:
    r = roof(F.col("roof_shape"), F.col("roof_height"), F.col("resolved_height"))
    return buildings.withColumn("__r", r).withColumns({"roof_profile": F.col("__r.profile"), "roof_rise": F.col("__r.height"), "roof_source": F.col("__r.source")}).drop("__r")


def rings(vertices: DataFrame) -> DataFrame:
    """One row per ring with `ring`, its vertices (x, z) in order."""
    made = vertices.groupBy("seed_id", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "z"))).alias("ring"))
    return made.withColumn("ring", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"))))


def polygon_measures(rings_: DataFrame) -> DataFrame:
    """Signed area and the mean of the vertices."""
    return rings_.withColumns({"area": geo.ring_area(F.col("ring")), "mean_x": geo.ring_mean(F.col("ring"), "x"), "mean_z": geo.ring_mean(F.col("ring"), "z")})


def clean_rings(rings_: DataFrame) -> DataFrame:
    """Rings without the repeated last vertex; those of at most 0.05 m2 become empty."""
    a, b, r = F.get("ring", 0), F.try_element_at("ring", F.lit(-1)), F.col("ring")
    same = (F.size(r) > 1) & (F.sqrt((a["x"] - b["x"]) ** 2 + (a["z"] - b["z"]) ** 2) < 0.001)
    cut = rings_.withColumn("ring", F.when(same, F.slice(r, 1, F.size(r) - 1)).otherwise(r))
    return cut.withColumn("ring", F.when(F.abs(geo.ring_area(F.col("ring"))) > 0.05, F.col("ring")).otherwise(F.slice("ring", 1, 0)))


def nearest_buildings(buildings: DataFrame, means: DataFrame, cap: int = 2500) -> DataFrame:
    """Per seed the `cap` buildings of the least score: distance of the vertex mean less a fifth of the height (to 100 m). Scores
    equal to the micrometre are equal, and of those the first building comes first.

    truncated: how many of the seed's buildings go.
    """
    score = F.sqrt(F.col("mean_x") ** 2 + F.col("mean_z") ** 2) - 0.2 * F.least(F.col("resolved_height"), F.lit(100.0))
    w = Window.partitionBy("seed_id").orderBy(F.round("score", 6), "ord")
    ranked = buildings.join(means, ["seed_id", "id"]).withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    counts = buildings.groupBy("seed_id").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).cast("long").alias("truncated"))
    return ranked.join(counts, "seed_id")


def merge_tile_fragments(fragments: DataFrame) -> DataFrame:
    """One building per id of fragments (id, ord, kind, height, signature): the first one's attributes, and the polygons of
    different signatures in order."""
    base = fragments.groupBy("id").agg(F.min_by(F.struct("kind", "height"), "ord").alias("f"), F.count(F.lit(1)).alias("n_fragments"))
    shapes = fragments.groupBy("id", "signature").agg(F.min("ord").alias("ord")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "signature"))).alias("s"))
    return base.join(shapes, "id").select("id", "f.kind", "f.height", "n_fragments", F.transform("s", lambda x: x["signature"]).alias("signatures"))


def signature(ring) -> F.Column:
    """First and last vertex at six decimals, and the number of vertices."""
    a, b = F.get(ring, 0), F.try_element_at(ring, F.lit(-1))
    return F.concat(F.format_string("%.6f,%.6f;%.6f,%.6f;", a["lon"], a["lat"], b["lon"], b["lat"]), F.size(ring).cast("string"))


def enrich_detailed(buildings: DataFrame, detailed: DataFrame) -> DataFrame:
    """buildings with their detailed model's columns (lod, n_surfaces), null where there is none."""
    return buildings.join(detailed, "id", "left")


def roof_faces(buildings: DataFrame, edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """One face per ring edge, as its two lower and its upper points' heights: hipped faces meet at the vertex mean, gabled
    ones at the ridge along the longer side, skillion ones rise along the shorter side; flat roofs lie at the top.

    buildings: seed_id, id, resolved_height, roof_profile, roof_rise; edges: path_segments(); boxes: min/max and mean_x, mean_z.
    """
    met = edges.join(buildings, ["seed_id", "id"]).join(boxes, ["seed_id", "id"])
    along_x = (F.col("max_x") - F.col("min_x")) >= (F.col("max_z") - F.col("min_z"))
    base, top = F.col("resolved_height") - F.col("roof_rise"), F.col("resolved_height")
    mid_x, mid_z = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_z") + F.col("max_z")) / 2

    def ramp(x, z):
        share = F.when(along_x, (z - F.col("min_z")) / F.greatest(F.col("max_z") - F.col("min_z"), F.lit(0.001))).otherwise((x - F.col("min_x")) / F.greatest(F.col("max_x") - F.col("min_x"), F.lit(0.001)))
        return base + F.col("roof_rise") * share

    p = F.col("roof_profile")
    low = lambda x, z: F.when(p == "skillion", ramp(x, z)).when(p == "flat", top + 0.025).otherwise(base)
    peak_x = F.when(p == "hipped", F.col("mean_x")).when(p == "gabled", F.when(along_x, (F.col("ax") + F.col("bx")) / 2).otherwise(mid_x))
    peak_z = F.when(p == "hipped", F.col("mean_z")).when(p == "gabled", F.when(along_x, mid_z).otherwise((F.col("az") + F.col("bz")) / 2))
    return met.select("seed_id", "id", "pos", p.alias("profile"), low(F.col("ax"), F.col("az")).alias("ay"), low(F.col("bx"), F.col("bz")).alias("by"), peak_x.alias("peak_x"), peak_z.alias("peak_z"), F.when(p.isin("hipped", "gabled"), top).alias("peak_y"))
