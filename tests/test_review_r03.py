"""Cases that a review of round 3 found."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_a_request_meets_one_cached_row_of_its_key(spark):
    from geoloom.sources.cache import load_missing

    requests = spark.createDataFrame([("p", "k1"), ("q", "k1"), ("r", "k2")], "id string, key string")
    cache = spark.createDataFrame([("k1", 1, 30), ("k1", 2, 50), ("k1", 3, 50), ("k1", 9, 10), ("k2", 4, 5)], "key string, value long, at long").select("key", "value", F.timestamp_seconds("at").alias("expires_at"))
    hits, misses = load_missing(requests, cache, F.timestamp_seconds(F.lit(20)))
    assert sorted((r["id"], r["value"]) for r in hits.collect()) == [("p", 3), ("q", 3)]
    assert [r["id"] for r in misses.collect()] == ["r"]


def test_a_triangle_holds_points_within_its_tolerance_across_a_cell(spark):
    from geoloom.operators.terrain import sample_tin

    tri = spark.createDataFrame([(0, 1, 28.0, 1.0, 28.0, 128.0, 1.0, 28.0, 28.0, 1.0, 128.0)], "seed_id int, tri int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    spots = spark.createDataFrame([(0, 1, 27.95, 70.0), (0, 2, 27.9, 70.0), (0, 3, 29.0, 70.0)], "seed_id int, point int, x double, z double")
    assert {r["point"]: r["how"] for r in sample_tin(spots, tri).collect()} == {1: "inside", 2: "vertex", 3: "inside"}


def test_scores_equal_but_for_noise_come_in_the_order_of_the_buildings(spark):
    from geoloom.operators.buildings import nearest_buildings

    buildings = spark.createDataFrame([(0, "a", 1, 10.0), (0, "b", 2, 10.0), (0, "c", 3, 10.0)], "seed_id int, id string, ord int, resolved_height double")
    means = spark.createDataFrame([(0, "a", 30.0 + 1e-9, 40.0), (0, "b", -30.0, 40.0), (0, "c", 29.0, 40.0)], "seed_id int, id string, mean_x double, mean_z double")
    assert {r["id"]: r["rank"] for r in nearest_buildings(buildings, means).collect()} == {"c": 1, "a": 2, "b": 3}


def test_the_twin_of_sidewalks_lays_a_pair_whole_at_the_cap(spark):
    import duckdb

    from geoloom.plans.registry import ORACLES
    from geoloom.plans import all_queries  # noqa: F401

    # 15,999 dashes of earlier roads, then a pair that starts at the cap's last place
    sql = ORACLES["g10_sidewalks_and_markings"]
    where = sql.split("AS lift FROM q WHERE ")[1].split("),\n")[0]
    rows = "SELECT 15999 AS n, 'marking' AS layer, 5 AS k UNION ALL SELECT 16000, 'sidewalk', 0 UNION ALL SELECT 16001, 'sidewalk', 1 UNION ALL SELECT 16002, 'marking', 2"
    assert duckdb.sql(f"SELECT n FROM ({rows}) WHERE {where} ORDER BY n").fetchall() == [(15999,), (16000,), (16001,)]


def test_dense_long_edges_are_copied_a_few_times(spark, monkeypatch):
    import random

    from geoloom.operators import spatial as S

    rnd, rows, dealt = random.Random(3), [], []
    for i in range(20_000):
        rows.append((0, f"e{i}", i, 0, *(rnd.uniform(-400, 400) for _ in range(4))))
    edges = spark.createDataFrame(rows, "seed_id int, edge string, ord int, entry int, ax double, az double, bx double, bz double")
    spots = spark.createDataFrame([(0, i, rnd.uniform(-400, 400), rnd.uniform(-400, 400)) for i in range(400)], "seed_id int, point int, x double, z double")
    columns = S._columns_of
    monkeypatch.setattr(S, "_columns_of", lambda *a: dealt.append(columns(*a)) or dealt[-1])
    S._nearest_in_cells(spots, edges, "point", 16.0)
    assert max(d.count() for d in dealt) < 5 * len(rows)


def test_roads_are_stitched_in_one_stream(spark):
    from geoloom.operators.roads import stitch_paths

    kind = "id string, ord int, path array<struct<x:double,z:double>>"
    rows = [(f"r{i}", k, [(float(i + 10 * k + j), 0.0) for j in range(11)] if k < 3 else None) for i in range(500) for k in (2, 0, 1, 3)]
    rows += [(None, 0, [(0.0, 0.0), (5.0, 0.0)]), (None, 1, [(5.0, 0.0), (9.0, 0.0)]), ("empty", 0, [])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = stitch_paths(spark.createDataFrame(rows, kind))
        got = {r["id"]: [p["x"] for p in r["path"]] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {f"r{i}": [float(i + j) for j in range(31)] for i in range(500)} | {None: [0.0, 5.0, 9.0], "empty": []}
    # a pandas call for each road took most of the time
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_and_visible_tiles_are_not_shuffled_as_pairs(spark):
    from geoloom.operators.tiling import visible_tiles

    at = spark.createDataFrame([(0, i, i * 40.0 - 400, 10.0, 300.0) for i in range(20)] + [(0, 99, None, None, 300.0)], "seed_id int, event_id int, x double, z double, radius double")
    tiles = spark.createDataFrame([(0, i, j) for i in range(-9, 10) for j in range(-9, 10)] * 2 + [(1, 0, 0)], "seed_id int, tile_x int, tile_z int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = visible_tiles(at, tiles, "walk")
        assert "SortMergeJoin" not in _plan(df)
        got = sorted(tuple(r) for r in df.select("event_id", "tile_x", "tile_z").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    from geoloom.functions.resolve import streaming_range

    reach = spark.range(1).select(streaming_range(F.lit("walk"), F.lit(300.0))["base"].alias("r")).first()["r"] + 300 * 2**0.5 / 2
    assert got == sorted((i, a, b) for i in range(20) for a in range(-9, 10) for b in range(-9, 10) if ((a * 300 - (i * 40.0 - 400)) ** 2 + (b * 300 - 10.0) ** 2) ** 0.5 <= reach)


def test_points_and_rings_are_decided_where_they_meet(spark):
    from geoloom.operators import spatial as S

    ring = lambda name, a, b: [(0, name, i, x, z) for i, (x, z) in enumerate(((a, a), (b, a), (b, b), (a, b), (a, a)))]
    rings = spark.createDataFrame(ring("big", -150.0, 150.0) + ring("small", 10.0, 12.0) + ring("over", 5.0, 60.0), "seed_id int, id string, pos int, x double, z double")
    spots = [(-100.0, 20.0), (11.0, 11.0), (8.0, 50.0), (149.5, 0.0), (151.0, 0.0), (200.0, 0.0), (-152.0, -152.0), (0.0, 0.0)]
    points = spark.createDataFrame([(0, i, x, z) for i, (x, z) in enumerate(spots)], "seed_id int, point int, x double, z double")
    inside = S.point_in_polygon(points, rings)
    assert sorted((r["point"], r["id"]) for r in inside.collect()) == sorted((i, n) for i, (x, z) in enumerate(spots) for n, a, b in (("big", -150, 150), ("small", 10, 12), ("over", 5, 60)) if a < x < b and a < z < b)
    seeds = spark.createDataFrame([(0, 1000.0)], "seed_id int, radius double")
    free = S.can_occupy(points, rings, seeds)
    assert sorted(r["point"] for r in free.collect()) == [5, 6]
    # pairs of points and rings went through a shuffle by point
    import re

    assert not any(re.search(r"hashpartitioning\([^)]*point#", _plan(df)) for df in (inside, free))


def test_a_point_meets_one_row_of_an_elevation_tile(spark):
    from geoloom.operators.terrain import sample_mosaic

    n, size = 1 << 14, 2
    pixels = spark.createDataFrame([(n // 2, n // 2 - 1, px, py, float(10 * px + py)) for px in (0, 1) for py in (0, 1)] + [(n // 2 + 1, n // 2 - 1, 0, 0, 5.0)], "tile_x int, tile_y int, px int, py int, elevation double")
    lon = lambda share: 360 / n * share
    points = spark.createDataFrame([(1, lon(0.25), 1e-9), (2, lon(0.75), 1e-9), (3, lon(1.25), 1e-9), (4, lon(3.5), 1e-9)], "point int, lon double, lat double")
    df = sample_mosaic(points, pixels, 14, size)
    got = {r["point"]: (r["missing"], r["elevation"]) for r in df.collect()}
    # at the lower edge the last row stands for the next
    assert {p: m for p, (m, _) in got.items()} == {1: False, 2: False, 3: True, 4: True}
    assert abs(got[1][1] - 6.0) < 1e-3 and abs(got[2][1] - 11.0) < 1e-3
    assert "Aggregate" not in _plan(df)


def test_clipping_works_each_term_out_once(spark):
    from geoloom.functions import geo
    from geoloom.operators.roads import clip_roads, path_segments

    vertices = spark.createDataFrame([(0, "a", 0, -20.0, 0.0), (0, "a", 1, 20.0, 0.0), (0, "a", 2, 20.0, 30.0), (0, "b", 0, 3.0, 4.0), (0, "b", 1, 3.0, 4.0), (0, "b", 2, 5.0, 6.0)], "seed_id int, id string, pos int, x double, z double")
    segments, seeds = path_segments(vertices), spark.createDataFrame([(0, 10.0)], "seed_id int, radius double")
    df = clip_roads(segments, seeds)
    got = sorted((r["id"], r["pos"], r["ax"], r["az"], r["bx"], r["bz"]) for r in df.collect())
    assert got == [("a", 0, -10.0, 0.0, 10.0, 0.0), ("b", 0, 3.0, 4.0, 3.0, 4.0), ("b", 1, 3.0, 4.0, 5.0, 6.0)]
    t = geo.clip_to_circle(*(F.col(c) for c in ("ax", "az", "bx", "bz")), F.lit(10.0))
    assert segments.withColumns(t).where("t0 is not null").count() == len(got)
    # the filter and both ends had a copy of the root each, in code too large to be compiled
    assert _plan(df).split("== Initial Plan ==")[0].count("SQRT(") == 1


def test_a_list_of_positions_is_read_once(spark):
    from geoloom.sources.files import position_list

    ring = [(35.0 + i / 1000, 139.0 + i / 1000, float(i)) for i in range(300)]
    text = " ".join(f"{a} {b} {c}" for a, b, c in [*ring, ring[0]])
    df = spark.createDataFrame([(1, text), (2, "35 139 1 95 185 2 36 140 3 x nan"), (3, ""), (4, None)], "id int, text string").select("id", position_list(F.col("text"), 3).alias("v"))
    got = {r["id"]: r["v"] and [(v["lat"], v["lon"], v["elevation"]) for v in r["v"]] for r in df.collect()}
    assert got == {1: ring, 2: [(35.0, 139.0, 1.0), (36.0, 140.0, 3.0)], 3: [], 4: []}
    # the text was split again for each number of each vertex
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_vertices_of_roads_are_laid_out_by_road_once(spark, monkeypatch):
    import re

    from geoloom.operators.roads import path_segments
    from geoloom.plans import views
    from geoloom.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    needs, sql = views.VIEWS["road_vertices"]
    stated = spark.sql(sql, **{n: views.view(spark, folder, n) for n in needs})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        monkeypatch.setattr(views.spread, "__defaults__", (100,))
        made = views.view(spark, folder, "road_vertices")
        segments = path_segments(Tables(spark, folder).road_points())
        # the tasks' number stood still while the table grew, and a road's rows were shuffled again
        assert not re.search(r"hashpartitioning\(seed_id#\d+, id#", _plan(segments))
        n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
        assert segments.rdd.getNumPartitions() >= n // 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert made.dtypes == stated.dtypes and sorted(map(tuple, made.collect())) == sorted(map(tuple, stated.collect()))


def test_a_step_of_a_walk_reads_the_buckets_of_its_walkers(spark, monkeypatch):
    from geoloom.operators import network as N

    plans, keep = [], N.durable
    monkeypatch.setattr(N, "durable", lambda df, *by: (plans.append(_plan(df)) if "trail" in df.columns else None) or keep(df, *by))
    monkeypatch.setattr(N, "BUCKET_WAYS", 10, raising=False)
    ways = spark.createDataFrame([(0, f"n{k}", f"n{k + 1}", f"e{k}", 10.0, False, k, 0) for k in range(60)], "seed_id int, node string, next_node string, edge string, length double, reversed boolean, ord int, entry int")
    starts = spark.createDataFrame([(0, "n0", 7, 195.0), (1, "n5", 7, 50.0)], "seed_id int, node string, rng long, target double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = sorted((r["seed_id"], r["step"], r["edge"]) for r in N.seeded_walks(starts, ways).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(0, k, f"e{k}") for k in range(20)]
    # each step sorted and shuffled the ways of all nodes
    assert plans and not any("hashpartitioning" in p for p in plans) and "dynamicpruning" in plans[-1]


def test_entries_of_a_road_come_from_one_row(spark):
    from geoloom.operators.roads import graph_entries
    from geoloom.plans.registry import Tables

    vertices = spark.createDataFrame([(0, "a", 1, 500.0, k, 10.0 * k, 0.0) for k in range(4)] + [(0, "far", 2, 500.0, 0, 900.0, 0.0), (0, "far", 2, 500.0, 1, 0.0, 0.0), (0, "bare", 3, 500.0, 0, 0.0, 5.0), (0, "bare", 3, 500.0, 1, 3.0, 9.0)], "seed_id int, id string, ord int, radius double, pos int, x double, z double")
    refs = spark.createDataFrame([(0, "a", 0, "near", 0.9, 14.0, 3.0), (0, "a", 0, "near", 0.9, 14.0, 3.0), (0, "a", 1, "off", 0.5, 14.0, 300.0), (0, "a", 2, "none", 1.0, None, None), (0, "far", 0, "x", 0.0, 0.0, 0.0)], "seed_id int, id string, ref_pos int, connector string, at double, x double, z double")
    got = sorted((r["id"], r["entry"], r["offset"], r["x"], r["key"]) for r in graph_entries(vertices, refs).collect())
    assert got == [
        ("a", 0, 0.0, 0.0, None), ("a", 1, 10.0, 10.0, None), ("a", 2, 14.0, 14.0, "connector:near"), ("a", 3, 15.0, 15.0, "connector:off"), ("a", 4, 20.0, 20.0, None), ("a", 5, 30.0, 30.0, "connector:none"),
        ("bare", 0, 0.0, 0.0, None), ("bare", 1, 5.0, 3.0, None),
    ]
    # references met all spans of their road in a join, after three readings of the vertices
    plan = _plan(Tables(spark, "/root/testdata/sf0.001").entries())
    assert plan.split("== Initial Plan ==")[0].count("lineitem.parquet") == 1 and "hashpartitioning(seed_id" not in plan


def test_world_stats_write_the_graph_once(spark, monkeypatch):
    from geoloom.plans import queries_world as Q
    from geoloom.plans.registry import Tables

    written = []
    monkeypatch.setattr(Q, "durable", lambda df: written.append(df.columns) or df)
    Q.stats(Tables(spark, "/root/testdata/sf0.001"))
    # nodes and edges, of which only counts are asked for, were written beside the pairs they are made of
    assert not written
