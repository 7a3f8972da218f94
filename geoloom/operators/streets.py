"""What is laid along streets: strips, sidewalks, markings, crosswalks, furniture; within each seed's budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import seeded_unit
from .roads import DRIVABLE, edges_with_points, node_degree, node_ends
from .scan import prefix_sum
from .storage import durable
from .terrain import lay
from .tiling import world_tile

DETAIL_CAP, TREE_CAP, JUNCTION_CAP = 16_000, 420, 180


def _length() -> Column:
    return F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("bz") - F.col("az")) ** 2)


def budget_prefix(items: DataFrame, cap: float, weight: str, order: str, key: str = "seed_id") -> DataFrame:
    """The items of each key, in order, before which less than `cap` of the weight (not negative) is spent."""
    return prefix_sum(items, key, [order], weight, "__before", cap).drop("__before")


def road_strips(segments: DataFrame, roads: DataFrame, grid: DataFrame) -> DataFrame:
    """Clipped segments (seed_id, id, pos, ax, az, bx, bz) as quads 0.14 m above the grid: the heights ay, by of both ends, the
    offset nx, nz of a corner from the line, and the tile of the middle; those under 0.05 m go."""
    met = segments.withColumn("length", _length()).where("length >= 0.05").join(roads.select("seed_id", "id", "width"), ["seed_id", "id"])
    half = F.least(F.col("width"), F.lit(30.0)) / 2
    made = met.withColumns({"nx": -(F.col("bz") - F.col("az")) / F.col("length") * half, "nz": (F.col("bx") - F.col("ax")) / F.col("length") * half, "x": (F.col("ax") + F.col("bx")) / 2, "z": (F.col("az") + F.col("bz")) / 2})
    strips = world_tile(made).select("seed_id", "id", "pos", "ax", "az", "bx", "bz", "nx", "nz", "length", "tile")
    return lay(strips, grid, {"ay": ("ax", "az"), "by": ("bx", "bz")}, 0.14)


def _details(segments: DataFrame, roads: DataFrame) -> DataFrame:
    """What each clipped segment asks of the budget: n_walks (0 or 2) and n_dashes, with its road's order and width."""
    met = segments.withColumn("length", _length()).where("length >= 2").join(roads.where(F.col("kind").isin(*DRIVABLE)).select("seed_id", "id", "ord", "kind", "width"), ["seed_id", "id"])
    walk = ~F.col("kind").isin("motorway", "trunk") & (F.col("width") >= 4)
    dash = (F.col("width") >= 6.5) & ~F.col("kind").isin("living_street", "service", "track") & (F.col("length") > 3.5)
    made = met.withColumns({"n_walks": F.when(walk, 2).otherwise(0), "n_dashes": F.when(dash, F.ceil((F.col("length") - 3.5) / 9).cast("int")).otherwise(0)})
    return made.withColumn("n_items", F.col("n_walks") + F.col("n_dashes")).where("n_items > 0")


def details_spent(segments: DataFrame, roads: DataFrame, cap: int = DETAIL_CAP) -> DataFrame:
    """seed_id, spent: how much of the budget sidewalks and markings take. Both walks of a segment come or none."""
    # read three times: by the total, and by a range partitioning, which samples first
    asked = durable(_details(segments, roads).select("seed_id", "ord", "pos", "n_walks", "n_items"))
    # the last segment begun may be one walk over the cap; its dashes stop at it
    total = asked.groupBy("seed_id").agg(F.sum("n_items").alias("n"))
    within = prefix_sum(asked, "seed_id", ["ord", "pos"], "n_items", "before", cap)
    last = within.groupBy("seed_id").agg(F.max_by(F.greatest(F.col("before") + F.col("n_walks"), F.least(F.col("before") + F.col("n_items"), F.lit(cap))), F.struct("ord", "pos")).alias("spent"))
    return total.join(last, "seed_id").select("seed_id", F.least("n", "spent").alias("spent"))


def sidewalks_and_markings(segments: DataFrame, roads: DataFrame, grid: DataFrame, cap: int = DETAIL_CAP) -> DataFrame:
    """Strips beside and on drivable roads, in order, while fewer than `cap` come before in the seed: seed_id, id, pos, k,
    layer (sidewalk: k = 0, 1; marking: k from 2 on), the strip's ends, sidewalks 0.18 m and markings 0.22 m above the grid."""
    side = F.col("width") / 2 + 0.72
    item = lambda k, layer, off, a, b: F.struct(k.alias("k"), F.lit(layer).alias("layer"), off.alias("off"), a.alias("from_m"), b.alias("to_m"))
    none = F.array().cast("array<struct<k:int,layer:string,off:double,from_m:double,to_m:double>>")
    walks = F.when(F.col("n_walks") > 0, F.array(item(F.lit(0), "sidewalk", side, F.lit(0.0), F.col("length")), item(F.lit(1), "sidewalk", -side, F.lit(0.0), F.col("length")))).otherwise(none)
    dashes = F.when(F.col("n_dashes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_dashes") - 1, F.lit(0))), lambda i: item((i + 2).cast("int"), "marking", F.lit(0.0), i * 9.0 + 2.5, F.least(F.col("length") - 0.5, i * 9.0 + 6.0)))).otherwise(none)
    # a sidewalk pair is laid whole, so budgets are met pair by pair and dash by dash
    begun = prefix_sum(durable(_details(segments, roads)), "seed_id", ["ord", "pos"], "n_items", "before", cap)
    rows = begun.select("seed_id", "id", "pos", "ax", "az", "bx", "bz", "length", "before", "n_walks", F.explode(F.concat(walks, dashes)).alias("i")).select("*", "i.*").drop("i")
    index = F.when(F.col("layer") == "marking", F.col("k") - 2 + F.col("n_walks")).otherwise(0)
    rows = rows.where(F.col("before") + index < cap)
    ux, uz = (F.col("bx") - F.col("ax")) / F.col("length"), (F.col("bz") - F.col("az")) / F.col("length")
    at = lambda m: ((F.col("ax") + ux * F.col(m) - uz * F.col("off")), (F.col("az") + uz * F.col(m) + ux * F.col("off")))
    (x0, z0), (x1, z1) = at("from_m"), at("to_m")
    strips = lay(rows.select("seed_id", "id", "pos", "k", "layer", x0.alias("x0"), z0.alias("z0"), x1.alias("x1"), z1.alias("z1")), grid, {"y0": ("x0", "z0"), "y1": ("x1", "z1")})
    lift = F.when(F.col("layer") == "sidewalk", 0.18).otherwise(0.22)
    return strips.withColumns({"y0": F.col("y0") + lift, "y1": F.col("y1") + lift})


def first_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of at least three edges with their degree and the way dx, dz along the first edge, its width."""
    first = node_ends(edges).groupBy("seed_id", "node").agg(F.min_by("edge", F.struct("ord", "entry")).alias("edge"))
    met = nodes.join(node_degree(edges).where("degree >= 3"), ["seed_id", "node"]).join(first, ["seed_id", "node"])
    e = edges_with_points(nodes, edges).select("seed_id", "edge", "from_node", "ax", "az", "bx", "bz", "width")
    met = met.join(e, ["seed_id", "edge"])
    # of the edge's ends the first that is over 0.5 m from the node
    far = F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("az") - F.col("z")) ** 2) > 0.5
    dx = F.when(far, F.col("ax")).otherwise(F.col("bx")) - F.col("x")
    dz = F.when(far, F.col("az")).otherwise(F.col("bz")) - F.col("z")
    return met.withColumns({"dx": dx, "dz": dz}).where("dx * dx + dz * dz > 0.25").withColumn("reach", F.greatest(F.lit(0.001), F.sqrt(F.col("dx") ** 2 + F.col("dz") ** 2)))


def crosswalks(nodes: DataFrame, edges: DataFrame, spent: DataFrame, grid: DataFrame, cap: int = DETAIL_CAP) -> DataFrame:
    """Five stripes at each node of three or more edges, in the order of the graph, while less than `cap` is spent in the seed
    (seed_id, spent: by sidewalks and markings): seed_id, node, stripe, ax, az, bx, bz and ay, by, 0.23 m above the grid."""
    asked = first_edges(nodes, edges).select("seed_id", "node", "x", "z", "dx", "dz", "reach", "width", F.col("first.ord").alias("ord"), F.col("first.k").alias("nth"), F.lit(5).alias("n_items"))
    # what is spent comes first in each seed
    lead = spent.select("seed_id", F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("nth"), F.col("spent").cast("int").alias("n_items"))
    begun = prefix_sum(durable(asked.unionByName(lead, allowMissingColumns=True)), "seed_id", ["ord", "nth"], "n_items", "before", cap).where("node is not null")
    made = begun.withColumn("stripe", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    ux, uz, half = F.col("dx") / F.col("reach"), F.col("dz") / F.col("reach"), F.col("width") * 0.48
    cx, cz = F.col("x") + ux * F.col("stripe") * 0.85, F.col("z") + uz * F.col("stripe") * 0.85
    strips = made.select("seed_id", "node", "stripe", (cx + uz * half).alias("ax"), (cz - ux * half).alias("az"), (cx - uz * half).alias("bx"), (cz + ux * half).alias("bz"))
    return lay(strips, grid, {"ay": ("ax", "az"), "by": ("bx", "bz")}, 0.23)


def street_furniture(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, grid: DataFrame) -> DataFrame:
    """Trees along edges, lights and every second time a sign at junctions in the order of the graph, within their budgets, on
    the ground of the grid (a sign on that of its light): seed_id, layer, owner, k, x, z, yaw, scale, y."""
    e = edges_with_points(nodes, edges).withColumn("span", _length()).where((F.col("length") >= 30) & ~F.col("kind").isin("motorway", "trunk") & (F.col("span") > 30))
    e = e.join(seeds.select("seed_id", "radius"), "seed_id")
    n = F.ceil((F.col("span") - 30) / 42).cast("int")
    t = e.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("at", F.col("k") * 42 + 22)
    side = F.when(seeded_unit(F.concat("edge", F.lit(":tree-side"))) > 0.5, 1.0).otherwise(-1.0) * (F.col("width") / 2 + 3.2)
    ux, uz = (F.col("bx") - F.col("ax")) / F.col("span"), (F.col("bz") - F.col("az")) / F.col("span")
    t = t.withColumns({"x": F.col("ax") + ux * F.col("at") - uz * side, "z": F.col("az") + uz * F.col("at") + ux * side}).where("sqrt(x * x + z * z) <= radius - 4")
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("seed_id").orderBy("ord", "entry", "k"))).where(F.col("rank") <= TREE_CAP)
    name = F.concat("edge", F.lit(":"), F.col("at").cast("string"))
    trees = t.select("seed_id", F.lit("tree").alias("layer"), F.col("edge").alias("owner"), "k", "x", "z", (seeded_unit(name) * 2 * math.pi).alias("yaw"), (seeded_unit(F.concat(name, F.lit(":scale"))) * 0.45 + 0.82).alias("scale"), F.col("x").alias("gx"), F.col("z").alias("gz"))
    j = first_edges(nodes, edges).join(seeds.select("seed_id", "radius"), "seed_id").where("sqrt(x * x + z * z) <= radius - 5")
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("seed_id").orderBy("first")) - 1).where(F.col("k") < JUNCTION_CAP)
    off = F.col("width") / 2 + 2.1
    vx, vz = F.col("dx") / F.col("reach"), F.col("dz") / F.col("reach")
    j = j.withColumns({"lx": F.col("x") - vz * off, "lz": F.col("z") + vx * off, "yaw": F.atan2("dx", "dz")})
    lights = j.select("seed_id", F.lit("light").alias("layer"), F.col("node").alias("owner"), "k", F.col("lx").alias("x"), F.col("lz").alias("z"), "yaw", F.lit(1.0).alias("scale"), F.col("lx").alias("gx"), F.col("lz").alias("gz"))
    signs = j.where("k % 2 = 0").select("seed_id", F.lit("sign").alias("layer"), F.col("node").alias("owner"), "k", (F.col("lx") + vx).alias("x"), (F.col("lz") + vz).alias("z"), "yaw", F.lit(1.0).alias("scale"), F.col("lx").alias("gx"), F.col("lz").alias("gz"))
    return lay(trees.unionByName(lights).unionByName(signs), grid, {"y": ("gx", "gz")}).drop("gx", "gz")
