"""Road paths, fragments, the road graph and what is laid along it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.parse import GRAPH_SPEEDS, lookup
from .storage import durable
from .terrain import lay
from .tiling import small

# Classes that can be driven on.
DRIVABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "living_street", "unclassified", "service", "track", "road", "unknown")


def path_segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of vertices (seed_id, id, pos, x, z): pos, ax, az, bx, bz."""
    w = Window.partitionBy("seed_id", "id").orderBy("pos")
    made = vertices.select("seed_id", "id", "pos", F.col("x").alias("ax"), F.col("z").alias("az"), F.lead("x").over(w).alias("bx"), F.lead("z").over(w).alias("bz"))
    return made.where(F.col("bx").isNotNull())


def _axes(vertices: DataFrame) -> list[str]:
    """x, z, and y where the vertices have a height."""
    return ["x", "z", *(["y"] if "y" in vertices.columns else [])]


def cumulative_offsets(vertices: DataFrame) -> DataFrame:
    """vertices with offset, the length from the start, and total, the path's length; in space where they have a height y."""
    w = Window.partitionBy("seed_id", "id").orderBy("pos")
    gaps = [F.col(c) - F.lag(c).over(w) for c in _axes(vertices)]
    step = F.coalesce(F.sqrt(sum((d * d for d in gaps[1:]), gaps[0] * gaps[0])), F.lit(0.0))
    return vertices.withColumn("step", step).withColumn("offset", F.sum("step").over(w)).withColumn("total", F.max("offset").over(Window.partitionBy("seed_id", "id"))).drop("step")


def locate_along(offsets: DataFrame, fractions: DataFrame) -> DataFrame:
    """The point at a fraction of each path's length: fractions (seed_id, id, fraction, each once) with x, z (and y).

    An as-of join: targets stand among the ends of the path's spans, and in one pass from its end to its start each takes the
    last span that ends at it or after; so the work grows with vertices plus targets.
    """
    w = Window.partitionBy("seed_id", "id").orderBy("pos")
    axes = _axes(offsets)
    ends = offsets.select("seed_id", "id", "pos", F.col("offset").alias("at"), *[F.lag(c).over(w).alias(f"a{c}") for c in axes], *[F.col(c).alias(f"b{c}") for c in axes], F.lag("offset").over(w).alias("before")).where("ax is not null")
    spans = ends.select("seed_id", "id", "pos", "at", F.lit(0).alias("kind"), F.struct(*[f"{e}{c}" for e in "ab" for c in axes], "before", F.col("at").alias("offset")).alias("s"))
    totals = offsets.groupBy("seed_id", "id").agg(F.max("total").alias("total"))
    targets = fractions.join(totals, ["seed_id", "id"]).select("seed_id", "id", "fraction", (geo.clamp(F.col("fraction"), 0.0, 1.0) * F.col("total")).alias("at"), F.lit(1).alias("kind"))
    back = Window.partitionBy("seed_id", "id").orderBy(F.desc("at"), "kind", F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = targets.unionByName(spans, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(back)).where("kind = 1 and s is not null")
    share = (F.col("at") - F.col("s.before")) / F.greatest(F.lit(0.001), F.col("s.offset") - F.col("s.before"))
    return first.select("seed_id", "id", "fraction", *[(F.col(f"s.a{c}") + (F.col(f"s.b{c}") - F.col(f"s.a{c}")) * share).alias(c) for c in axes])


def clip_roads(segments: DataFrame, seeds: DataFrame) -> DataFrame:
    """Segments cut to their seed's circle; those outside go."""
    met = segments.join(seeds.select("seed_id", "radius"), "seed_id")
    ax, az, bx, bz, r = (F.col(c) for c in ("ax", "az", "bx", "bz", "radius"))
    dx, dz = bx - ax, bz - az
    # geo.clip_to_circle() step by step, and a generator instead of a filter: each term is worked out once, and the code of a row
    # stays small enough to be compiled
    met = met.withColumns({"__a": dx * dx + dz * dz, "__b": 2 * (ax * dx + az * dz), "__c": ax * ax + az * az - r * r})
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    met = met.withColumn("__disc", b * b - 4 * a * c)
    met = met.withColumns({"__root": F.sqrt(F.greatest("__disc", F.lit(0.0))), "__safe": F.when(a > 0, 2 * a)})
    met = met.withColumns({"__low": F.greatest(F.lit(0.0), (-b - F.col("__root")) / F.col("__safe")), "__high": F.least(F.lit(1.0), (-b + F.col("__root")) / F.col("__safe"))})
    low, high, crosses = F.col("__low"), F.col("__high"), (a > 0) & (F.col("__disc") >= 0) & (F.col("__low") <= F.col("__high"))
    at = lambda p, q, t: F.col(p) + (F.col(q) - F.col(p)) * t
    part = lambda t0, t1: F.array(F.struct(at("ax", "bx", t0).alias("ax"), at("az", "bz", t0).alias("az"), at("ax", "bx", t1).alias("bx"), at("az", "bz", t1).alias("bz")))
    cut = F.explode(F.when(crosses, part(low, high)).when((a == 0) & (c <= 0), part(F.lit(0.0), F.lit(1.0)))).alias("cut")
    return met.select("seed_id", "id", "pos", cut).select("seed_id", "id", "pos", "cut.*")


def drivable(roads: DataFrame) -> DataFrame:
    return roads.where(F.col("kind").isin(*DRIVABLE))


def graph_speed(kind: Column) -> Column:
    return lookup(GRAPH_SPEEDS, kind, 30.0)


def merge_close(entries: Column, gap: float = 0.55) -> Column:
    """Entries (offset, ..., key) in order: one closer than `gap` to the last kept goes, unless it has a key: then it takes
    the last one's place."""
    def step(kept, e):
        last = F.try_element_at(kept, F.lit(-1))
        near = (F.size(kept) > 0) & (F.abs(last["offset"] - e["offset"]) < gap)
        return F.when(~near | (F.size(kept) == 0), F.concat(kept, F.array(e))).when(e["key"].isNotNull(), F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(e))).otherwise(kept)

    return F.aggregate(entries, F.filter(entries, lambda e: F.lit(False)), step)


def compact(points: Column, gap: float = 0.3) -> Column:
    """Points (x, ..., z) less those closer than `gap` to the last kept one."""
    def step(kept, p):
        last = F.try_element_at(kept, F.lit(-1))
        far = F.sqrt((p["x"] - last["x"]) * (p["x"] - last["x"]) + (p["z"] - last["z"]) * (p["z"] - last["z"])) >= gap
        return F.when((F.size(kept) == 0) | far, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, F.filter(points, lambda p: F.lit(False)), step)


def attach_connectors(refs: DataFrame, connectors: DataFrame, offsets: DataFrame) -> DataFrame:
    """Connector references (seed_id, id, connector, at) with their position: the connector's own (connector, cx, cz), or
    the road's point at the fraction `at`."""
    found = refs.join(connectors, "connector", "left")
    missing = found.where("cx is null").select("seed_id", "id", F.col("at").alias("fraction")).distinct()
    made = locate_along(offsets, missing).select("seed_id", "id", F.col("fraction").alias("at"), F.col("x").alias("mx"), F.col("z").alias("mz"))
    return found.join(made, ["seed_id", "id", "at"], "left").select("seed_id", "id", "connector", "at", F.coalesce("cx", "mx").alias("x"), F.coalesce("cz", "mz").alias("z"))


def longest_part(vertices: DataFrame) -> DataFrame:
    """Of roads with several parts (seed_id, id, part, pos, x, z) the vertices of the longest one, of equal ones the first."""
    w = Window.partitionBy("seed_id", "id", "part").orderBy("pos")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("z") - F.lag("z").over(w)) ** 2)
    lengths = vertices.withColumn("__step", F.coalesce(step, F.lit(0.0))).groupBy("seed_id", "id", "part").agg(F.sum("__step").alias("length"))
    best = lengths.groupBy("seed_id", "id").agg(F.max_by("part", F.struct("length", -F.col("part"))).alias("part"))
    return vertices.join(best, ["seed_id", "id", "part"], "left_semi")


def merge_road_fragments(fragments: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per road of fragments (id, ord, kind, width, name): the first one's attributes, the number of fragments, and
    of the references (id, ord, connector, at) the last of each connector, in order of `at`."""
    base = fragments.groupBy("id").agg(F.min_by(F.struct("kind", "width", "name"), "ord").alias("f"), F.count(F.lit(1)).alias("n_fragments")).select("id", "f.*", "n_fragments")
    last = refs.groupBy("id", "connector").agg(F.max_by("at", "ord").alias("at"))
    lists = last.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "connector"))).alias("refs"))
    return base.join(lists, "id", "left").withColumn("connectors", F.transform("refs", lambda r: r["connector"])).drop("refs")


def _stitch(rest: list[list[tuple[float, float]]], reach: float) -> list[tuple[float, float]]:
    """The path that fragments in order make: see stitch_paths()."""
    run = lambda ps: sum(math.dist(a, b) for a, b in zip(ps, ps[1:]))
    out = rest.pop(max(range(len(rest)), key=lambda i: (run(rest[i]), -i)))
    while rest:
        ways = []
        for i, p in enumerate(rest):
            for k, (a, b) in enumerate(((out[-1], p[0]), (out[-1], p[-1]), (out[0], p[-1]), (out[0], p[0]))):
                ways.append((math.dist(a, b), i, k))
        d, i, k = min(ways)
        p = rest.pop(i)
        if d <= reach:
            p = p[::-1] if k in (1, 3) else p
            out = out + p[1 if d < 0.01 else 0 :] if k < 2 else p[: -1 if d < 0.01 else None] + out
    return out


def stitch_paths(fragments: DataFrame, reach: float = 12.0) -> DataFrame:
    """One path per id of fragments (id, ord, path array<(x, z)>): from the longest fragment on, the nearest other is
    joined end to end if it is within `reach`, and left out otherwise. A road's fragments are few.

    Fragments come sorted by road, so a task goes through its roads in one stream."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def stitched(t: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        paths = t["path"].combine_chunks()
        paths = paths.chunk(0) if isinstance(paths, pa.ChunkedArray) else paths
        ends = [0, *pc.cumulative_sum(pc.fill_null(pc.list_value_length(paths), 0)).to_pylist()]
        flat = paths.flatten()
        if sum(pc.struct_field(flat, c).null_count for c in ("x", "z")):
            raise ValueError("a vertex of a path has no place")
        places = list(zip(*(pc.struct_field(flat, c).to_numpy(zero_copy_only=False).tolist() for c in ("x", "z"))))
        offsets, made = [0], []
        for a, z in zip(cuts, cuts[1:]):
            rest = [places[ends[i] : ends[i + 1]] for i in range(a, z) if ends[i + 1] > ends[i]]
            made += _stitch(rest, reach) if rest else []
            offsets.append(len(made))
        ids = t["id"].take(pa.array(cuts[:-1], pa.int64())).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        axes = [pa.array([p[k] for p in made], pa.float64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(axes, ["x", "z"]))], ["id", "path"])

    def run(batches):
        held: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids = b["id"]
            one, two = ids[:-1], ids[1:]
            new = pc.or_(pc.fill_null(pc.not_equal(one, two), False), pc.xor(one.is_null(), two.is_null()))
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), b.num_rows]
            # the last road may go on in the next batch
            if held and ids[0].as_py() != last:
                h = pa.concat_tables(held)
                yield stitched(h, [0, h.num_rows])
                held = []
            if len(cuts) > 2:
                first = pa.concat_tables([*held, t.slice(0, cuts[-2])])
                before = first.num_rows - cuts[-2]
                yield stitched(first, [0, *(c + before for c in cuts[1:-1])])
                held = []
            held.append(t.slice(cuts[-2]))
            last = ids[-1].as_py()
        if held:
            h = pa.concat_tables(held)
            yield stitched(h, [0, h.num_rows])

    kind = dict(fragments.dtypes)["id"]
    place = "array<struct<x:double,z:double>>"
    laid = fragments.select("id", "ord", F.col("path").cast(place).alias("path")).repartition("id").sortWithinPartitions("id", F.asc_nulls_last("ord"))
    return laid.select("id", "path").mapInArrow(run, f"id {kind}, path {place}")


def graph_entries(vertices: DataFrame, refs: DataFrame, margin: float = 120.0) -> DataFrame:
    """Each road's entries in order: its vertices near the seed and its connectors, close ones merged.

    vertices: seed_id, id, ord, radius, pos, x, z; refs: seed_id, id, ref_pos, connector, at, x, z (the position, or null).
    A connector within 24 m of the path stands at the nearest point of it, another at the fraction `at` of its length.
    A reference is named by its ref_pos, connector and `at`. Both sides become one row per road, which is worked on as a whole.
    """
    road = ["seed_id", "id"]
    paths = vertices.groupBy(*road, "ord", "radius").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "z"))).alias("path"))
    lists = refs.groupBy(*road).agg(F.collect_list(F.struct("ref_pos", "connector", "at", "x", "z")).alias("refs"))
    return entries_of_roads(paths.join(lists, road, "left"), margin)


def entries_of_roads(roads: DataFrame, margin: float = 120.0) -> DataFrame:
    """graph_entries() of roads as rows: seed_id, id, ord, radius, path array<(pos, x, z)> in order, refs array<(ref_pos, connector,
    at, x, z)> or null."""
    near = F.filter("path", lambda p: F.sqrt(p["x"] * p["x"] + p["z"] * p["z"]) <= F.col("radius") + margin)
    refs = F.array_distinct(F.coalesce("refs", F.array().cast(dict(roads.dtypes)["refs"])))
    made = geo.once(near, lambda p: F.when(F.size(p) >= 2, geo.once(_with_offsets(p), lambda o: merge_close(_all_entries(o, refs)))))
    return roads.select("seed_id", "id", "ord", F.posexplode(made).alias("entry", "e")).select("seed_id", "id", "ord", "entry", "e.offset", "e.x", "e.z", "e.key")


def _with_offsets(path: Column) -> Column:
    """Points (pos, x, z) with their offset from the first."""
    def step(made, p):
        last = F.try_element_at(made, F.lit(-1))
        gap = F.sqrt((p["x"] - last["x"]) * (p["x"] - last["x"]) + (p["z"] - last["z"]) * (p["z"] - last["z"]))
        return F.concat(made, F.array(F.struct(p["pos"].alias("pos"), p["x"].alias("x"), p["z"].alias("z"), F.coalesce(last["offset"] + gap, F.lit(0.0)).alias("offset"))))

    start = F.transform(F.filter(path, lambda p: F.lit(False)), lambda p: F.struct(p["pos"].alias("pos"), p["x"].alias("x"), p["z"].alias("z"), F.lit(0.0).alias("offset")))
    return F.aggregate(path, start, step)


def _all_entries(path: Column, refs: Column) -> Column:
    """A path's points (pos, x, z, offset) and its references as entries (offset, rank, x, z, key) in order."""
    total, end = F.element_at(path, -1)["offset"], F.element_at(path, -1)
    pairs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.get(path, i - 1).alias("a"), F.get(path, i).alias("b")))

    def foot(r, s):
        a, b = s["a"], s["b"]
        t = geo.project(r["x"], r["z"], a["x"], a["z"], b["x"], b["z"])["t"]
        at = lambda t: F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["z"] + (b["z"] - a["z"]) * t).alias("z"), (a["offset"] + (b["offset"] - a["offset"]) * t).alias("offset"))
        away = lambda q: F.sqrt((r["x"] - q["x"]) * (r["x"] - q["x"]) + (r["z"] - q["z"]) * (r["z"] - q["z"]))
        return geo.once(geo.once(t, at), lambda q: F.struct(away(q).alias("d"), b["pos"].alias("pos"), q["x"].alias("x"), q["z"].alias("z"), q["offset"].alias("offset")))

    def there(s, target):
        a, b = s["a"], s["b"]
        share = (target - a["offset"]) / F.greatest(F.lit(0.001), b["offset"] - a["offset"])
        return F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["z"] + (b["z"] - a["z"]) * share).alias("z"))

    def entry(r, spans):
        target = r["at"] * total
        first = F.get(F.filter(spans, lambda s: s["b"]["offset"] >= target), 0)
        nearest = F.when(r["x"].isNotNull(), F.array_min(F.transform(spans, lambda s: foot(r, s))))
        rank, key = (r["ref_pos"] + 1_000_000).alias("rank"), F.concat(F.lit("connector:"), r["connector"]).alias("key")
        made = lambda offset, x, z: F.struct(offset.alias("offset"), rank, x.alias("x"), z.alias("z"), key)
        placed = geo.once(first, lambda s: geo.once(there(s, target), lambda q: made(target, F.coalesce(q["x"], end["x"]), F.coalesce(q["z"], end["z"]))))
        return geo.once(nearest, lambda f: F.when(F.coalesce(f["d"] < 24, F.lit(False)), made(f["offset"], f["x"], f["z"])).otherwise(placed))

    # of equal offsets vertices come before connectors
    plain = F.transform(path, lambda p: F.struct(p["offset"].alias("offset"), p["pos"].alias("rank"), p["x"].alias("x"), p["z"].alias("z"), F.lit(None).cast("string").alias("key")))
    return F.array_sort(F.concat(plain, geo.once(pairs, lambda spans: F.transform(refs, lambda r: entry(r, spans)))))


#: What a graph's edge has of its road.
ROAD = ("kind", "one_way", "width", "name")


def build_road_graph(roads: DataFrame | None, entries: DataFrame, grid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (seed_id, node, x, z, first: their order; with a grid also y, 0.09 m above it) and edges of the drivable roads (seed_id, id, kind, one_way, width, name).

    A node is a connector or a 1.25 m cell; it stands where the first entry of an edge long enough (0.75 m) puts it, by
    road order and entry. Edges between different nodes are kept; nodes without edges go.
    roads may be None if the entries are those of drivable roads and have the columns ROAD.
    """
    cell = lambda c: geo.half_up(F.col(c) / 1.25).cast("long").cast("string")
    keyed = entries.withColumn("node", F.coalesce("key", F.concat_ws(":", F.lit("node"), cell("x"), cell("z"))))
    w = Window.partitionBy("seed_id", "id").orderBy("entry")
    pairs = keyed.withColumns({"to_node": F.lead("node").over(w), "bx": F.lead("x").over(w), "bz": F.lead("z").over(w)}).where("to_node is not null")
    length = F.sqrt((F.col("bx") - F.col("x")) * (F.col("bx") - F.col("x")) + (F.col("bz") - F.col("z")) * (F.col("bz") - F.col("z")))
    pairs = pairs.withColumn("length", length).where("length >= 0.75")
    # nodes and edges, and often more, are made of these
    pairs = durable(pairs if roads is None else pairs.join(drivable(roads).select("seed_id", "id", *ROAD), ["seed_id", "id"]))
    linked = (F.col("node") != F.col("to_node")).alias("linked")
    ends = pairs.select("seed_id", "node", "ord", (F.col("entry") * 2).alias("k"), "x", "z", linked).unionByName(pairs.select("seed_id", F.col("to_node").alias("node"), "ord", (F.col("entry") * 2 + 1).alias("k"), F.col("bx").alias("x"), F.col("bz").alias("z"), linked))
    nodes = ends.groupBy("seed_id", "node").agg(F.min_by(F.struct("x", "z"), F.struct("ord", "k")).alias("p"), F.min(F.struct("ord", "k")).alias("first"), F.max("linked").alias("linked")).where("linked").select("seed_id", "node", "p.x", "p.z", "first")
    edges = pairs.where("node <> to_node").select(
        "seed_id", F.concat(F.lit("edge:"), "id", F.lit(":"), F.col("entry").cast("string")).alias("edge"), F.col("id").alias("road"), "ord", "entry",
        F.col("node").alias("from_node"), "to_node", "length", "kind", "one_way", "width", "name", graph_speed(F.col("kind")).alias("speed_limit"),
    )
    return (nodes if grid is None else lay(nodes, grid, {"y": ("x", "z")}, 0.09)), edges


def node_ends(edges: DataFrame) -> DataFrame:
    return edges.select("seed_id", F.explode(F.array("from_node", "to_node")).alias("node"), "edge", "ord", "entry")


def node_degree(edges: DataFrame) -> DataFrame:
    return node_ends(edges).groupBy("seed_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(node_ends(edges).select("seed_id", "node"), ["seed_id", "node"], "left_semi")


def edges_with_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their ends' positions ax, az, bx, bz."""
    a = nodes.select("seed_id", F.col("node").alias("from_node"), F.col("x").alias("ax"), F.col("z").alias("az"))
    b = nodes.select("seed_id", F.col("node").alias("to_node"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    return edges.join(a, ["seed_id", "from_node"]).join(b, ["seed_id", "to_node"])


def adjacency(edges: DataFrame) -> DataFrame:
    """The ways that edges can be driven: node, next_node, edge, length, reversed."""
    way = lambda a, b, back: F.struct(F.col(a).alias("node"), F.col(b).alias("next_node"), F.lit(back).alias("reversed"))
    ways = F.array_compact(F.array(F.when(F.col("one_way") != "backward", way("from_node", "to_node", False)), F.when(F.col("one_way") != "forward", way("to_node", "from_node", True))))
    return edges.select("seed_id", "edge", "ord", "entry", "length", F.explode(ways).alias("w")).select("seed_id", "w.node", "w.next_node", "edge", "length", "w.reversed", "ord", "entry")


def route_start(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Each seed's node nearest to the origin of those with two ways out, else of all."""
    out = ways.groupBy("seed_id", "node").agg(F.count(F.lit(1)).alias("n_ways"))
    rank = F.struct(F.when(F.coalesce("n_ways", F.lit(0)) >= 2, 0).otherwise(1).alias("a"), F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")).alias("d"), F.col("node").alias("n"))
    return nodes.join(out, ["seed_id", "node"], "left").groupBy("seed_id").agg(F.min_by(F.struct("node", "x", "z"), rank).alias("chosen")).select("seed_id", "chosen.*")


def drivable_length(edges: DataFrame) -> DataFrame:
    return edges.groupBy("seed_id", "kind").agg(F.sum("length").alias("meters"), F.count(F.lit(1)).alias("n_edges"))


def spawn_points(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """Per seed the `most` nodes of highest degree (then in the order of the graph), with the heading of their first edge."""
    w = Window.partitionBy("seed_id").orderBy(F.desc("degree"), "first")
    tips = node_ends(edges).groupBy("seed_id", "node").agg(F.count(F.lit(1)).alias("degree"), F.min_by("edge", F.struct("ord", "entry")).alias("edge"))
    best = durable(nodes.join(tips, ["seed_id", "node"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("seed_id", "node", "x", "z", "degree", "rank", "edge"))
    # the few edges and nodes asked for are sought where they lie
    own = durable(edges.select("seed_id", "edge", "from_node", "to_node").join(small(best.select("seed_id", "edge")), ["seed_id", "edge"], "left_semi"))
    near = nodes.select("seed_id", "node", "x", "z").join(small(own.select("seed_id", F.explode(F.array("from_node", "to_node")).alias("node"))), ["seed_id", "node"], "left_semi")
    met = best.join(edges_with_points(near, own).select("seed_id", "edge", "from_node", "ax", "az", "bx", "bz"), ["seed_id", "edge"])
    sign = F.when(F.col("from_node") == F.col("node"), 1.0).otherwise(-1.0)
    return met.withColumn("heading", F.atan2((F.col("bx") - F.col("ax")) * sign, (F.col("bz") - F.col("az")) * sign)).select("seed_id", "node", "x", "z", "degree", "rank", "edge", "heading")


def timed_spawn_points(nodes: DataFrame, edges: DataFrame, points: DataFrame, most: int = 8) -> DataFrame:
    """spawn_points() behind the start of each seed's timed route (points: seed_id, pos, x, z), which heads for its second
    point; together `most`. A seed whose route has fewer than two points has its nodes alone."""
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    start = points.where("pos < 2").groupBy("seed_id").agg(at(0, "x").alias("x"), at(0, "z").alias("z"), at(1, "x").alias("nx"), at(1, "z").alias("nz")).where("x is not null and nx is not null")
    first = start.select("seed_id", F.lit("time-attack").alias("node"), "x", "z", F.lit(1).alias("rank"), F.atan2(F.col("nx") - F.col("x"), F.col("nz") - F.col("z")).alias("heading"))
    rest = spawn_points(nodes, edges, most).join(start.select("seed_id", F.lit(1).alias("ahead")), "seed_id", "left").withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))
    return first.unionByName(rest.where(F.col("rank") <= most).select("seed_id", "node", "x", "z", "rank", "heading"))


def checkpoints_along(vertices: DataFrame, spacing: float) -> DataFrame:
    """Points every `spacing` metres along paths (seed_id, id, pos, x, z and y where there are heights), from the start on;
    the end is added if it is over 0.35 spacings from the last, else it takes its place: seed_id, id, k, x, z (and y)."""
    offs, axes = cumulative_offsets(vertices), _axes(vertices)
    totals = offs.groupBy("seed_id", "id").agg(F.max("total").alias("total"), F.min_by(F.struct(*axes), "pos").alias("a"), F.max_by(F.struct(*axes), "pos").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ks = totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("total") / spacing).cast("int")))).withColumn("fraction", F.when(F.col("total") > 0, F.col("k") * spacing / F.col("total")).otherwise(0.0))
    inner = locate_along(offs, ks.where("k > 0").select("seed_id", "id", "fraction"))
    points = ks.join(inner, ["seed_id", "id", "fraction"], "left").select("seed_id", "id", "k", *[F.coalesce(c, f"a.{c}").alias(c) for c in axes], "b")
    w = Window.partitionBy("seed_id", "id")
    far = F.sqrt(sum(((F.col(c) - F.col(f"b.{c}")) ** 2 for c in axes), F.lit(0.0))) > 0.35 * spacing
    marked = points.withColumn("last", F.col("k") == F.max("k").over(w)).withColumn("far", far)
    end = marked.where("last").select("seed_id", "id", F.when(F.col("far"), F.col("k") + 1).otherwise(F.col("k")).alias("k"), *[f"b.{c}" for c in axes])
    return marked.where("not last or far").select("seed_id", "id", "k", *axes).unionByName(end)
