"""Operators on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import buildings as B
from geoloom.operators import network as N
from geoloom.operators import osm as O
from geoloom.operators import roads as R
from geoloom.operators import spatial as S
from geoloom.operators import terrain as E
from geoloom.operators import tiling as T
from geoloom.operators import world as W
from geoloom.sources import cache, demo, files
from geoloom.streaming import run
from geoloom.streaming import telemetry as M

SEED = "seed_id int, lon double, lat double, radius double"


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(1, 139.767125, 35.681236, 500.0)], SEED)


def square(spark, half=5.0):
    ring = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    return spark.createDataFrame([(1, "sq", i, x, z) for i, (x, z) in enumerate(ring)], "seed_id int, id string, pos int, x double, z double")


def points(spark, *xz):
    return spark.createDataFrame([(1, i, float(x), float(z)) for i, (x, z) in enumerate(xz)], "seed_id int, point int, x double, z double")


def test_point_in_polygon_and_occupancy(spark):
    p = points(spark, (0, 0), (9, 0), (10, 0), (51, 0), (5.5, 0))
    assert {r["point"] for r in S.point_in_polygon(p, square(spark), size=10.0).collect()} == {0}
    world = spark.createDataFrame([(1, 0.0, 0.0, 50.0)], SEED)
    assert {r["point"] for r in S.can_occupy(p, square(spark), world, size=10.0).collect()} == {1, 2}


def test_world_tiles(spark):
    p = points(spark, (0, 0), (149.9, -149.9), (150, -150.1))
    assert [r["tile"] for r in T.world_tile(p).orderBy("point").collect()] == ["0:0", "0:0", "1:-1"]


def road_table(spark, paths, kind="residential", one_way="both"):
    roads = spark.createDataFrame([(1, f"r{i}", i, kind, one_way, 6.0, None) for i in range(len(paths))], "seed_id int, id string, ord int, kind string, one_way string, width double, name string")
    rows = [(1, f"r{i}", i, 500.0, k, float(x), float(z)) for i, p in enumerate(paths) for k, (x, z) in enumerate(p)]
    return roads, spark.createDataFrame(rows, "seed_id int, id string, ord int, radius double, pos int, x double, z double")


def no_refs(spark, rows=()):
    return spark.createDataFrame(list(rows), "seed_id int, id string, ref_pos int, connector string, at double, x double, z double")


def crossing(spark, **more):
    roads, paths = road_table(spark, [[(-50, 0), (50, 0)], [(0, -50), (0, 50)]], **more)
    refs = no_refs(spark, [(1, "r0", 0, "crossing", 0.5, 0.0, 0.0), (1, "r1", 0, "crossing", 0.5, None, None)])
    return R.build_road_graph(roads, R.graph_entries(paths, refs))


def test_crossing_roads_share_a_node(spark):
    nodes, edges = crossing(spark)
    assert edges.count() == 4 and {r["node"]: r["degree"] for r in R.node_degree(edges).collect()}["connector:crossing"] == 4
    assert nodes.count() == 5
    assert crossing(spark, kind="footway")[1].count() == 0
    assert {r["one_way"] for r in crossing(spark, one_way="forward")[1].collect()} == {"forward"}


def test_nearest_road_is_the_brute_force_one(spark):
    rnd = random.Random(3)
    edges = [(1, f"e{i}", i, 0, *(rnd.uniform(-300, 300) for _ in range(2)), 0.0, 0.0) for i in range(40)]
    edges = [(s, e, o, n, ax, az, ax + rnd.uniform(-80, 80), az + rnd.uniform(-80, 80)) for s, e, o, n, ax, az, _, _ in edges]
    pts = [(rnd.uniform(-600, 600), rnd.uniform(-600, 600)) for _ in range(60)]
    table = spark.createDataFrame(edges, "seed_id int, edge string, ord int, entry int, ax double, az double, bx double, bz double")

    def distance(p, e):
        ax, az, bx, bz = e[4:]
        t = max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - az) * (bz - az)) / ((bx - ax) ** 2 + (bz - az) ** 2)))
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - az - t * (bz - az))

    got = {r["point"]: r["distance"] for r in S.nearest_road(points(spark, *pts), table, pad=4.0).collect()}
    assert got == pytest.approx({i: min(distance(p, e) for e in edges) for i, p in enumerate(pts)})
    assert {r["point"] for r in S.nearest_road_indexed(points(spark, *pts), table).collect()} == set(range(60))


def test_walks_repeat_and_routes_have_checkpoints(spark, seeds):
    ring = [(100 * math.cos(a * math.pi / 6), 100 * math.sin(a * math.pi / 6)) for a in range(13)]
    roads, paths = road_table(spark, [ring, [(-100, 0), (100, 0)], [(0, -100), (0, 100)]])
    refs = no_refs(spark, [(1, "r1", 0, "mid", 0.5, 0.0, 0.0), (1, "r2", 0, "mid", 0.5, 0.0, 0.0)])
    nodes, edges = R.build_road_graph(roads, R.graph_entries(paths, refs))
    ways = R.adjacency(edges)
    starts = N.walk_starts(seeds, nodes, R.route_start(nodes, ways))
    a, b = (sorted(map(tuple, N.seeded_walks(starts, ways, 20).collect())) for _ in range(2))
    assert a == b and a
    routes, pts = N.drive_routes(spark.createDataFrame(a, "seed_id int, step int, edge string, node string, next_node string, length double"), nodes, seeds)
    assert routes.first()["route"].startswith("drive-") and R.checkpoints_along(pts, routes.first()["spacing"]).count() >= 2


def test_spawns_begin_with_the_timed_route(spark):
    nodes, edges = crossing(spark)
    route = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 4.0, 2.0), (1, 2, 9.0, 9.0)], "seed_id int, pos int, x double, z double")
    got = [tuple(r) for r in R.timed_spawn_points(nodes, edges, route, 3).orderBy("rank").select("node", "x", "rank").collect()]
    assert got[0] == ("time-attack", 1.0, 1) and got[1][0] == "connector:crossing" and [g[2] for g in got] == [1, 2, 3]
    assert R.timed_spawn_points(nodes, edges, route, 3).where("rank = 1").first()["heading"] == pytest.approx(math.pi / 2)
    alone = R.timed_spawn_points(nodes, edges, route.where("pos = 0"), 3)
    assert sorted(r["rank"] for r in alone.collect()) == [1, 2, 3] and not alone.where("node = 'time-attack'").count()


def test_lookahead_turns_at_the_bend(spark):
    roads, paths = road_table(spark, [[(0, 40), (0, 0)], [(0, 0), (40, 0)]])
    refs = no_refs(spark, [(1, "r0", 0, "bend", 1.0, 0.0, 0.0), (1, "r1", 0, "bend", 0.0, 0.0, 0.0)])
    nodes, edges = R.build_road_graph(roads, R.graph_entries(paths, refs))
    car = spark.createDataFrame([(1, 7, 0.0, 5.0, math.pi, 10.0, "edge:r0:0", 0.0, 5.0)], "seed_id int, event_id int, x double, z double, heading double, speed double, edge string, px double, pz double")
    got = N.graph_lookahead(car, R.edges_with_points(nodes, edges)).first()
    assert got["target_x"] > 0 and got["corner_severity"] > 0 and 15 <= got["recommended_speed"] <= 30


def test_stitching(spark):
    rows = [("a", 0, [(0.0, 0.0), (50.0, 0.0)]), ("a", 1, [(60.0, 0.0), (51.0, 0.0)]), ("a", 2, [(500.0, 0.0), (510.0, 0.0)])]
    got = R.stitch_paths(spark.createDataFrame(rows, "id string, ord int, path array<struct<x:double,z:double>>")).first()
    assert [p["x"] for p in got["path"]] == [0.0, 50.0, 51.0, 60.0]


def test_merge_close_keeps_connectors(spark):
    rows = [([(0.0, 0, 0.0, 0.0, None), (0.3, 1, 0.3, 0.0, "c"), (0.5, 2, 0.5, 0.0, None), (2.0, 3, 2.0, 0.0, None)],)]
    df = spark.createDataFrame(rows, "e array<struct<offset:double,rank:int,x:double,z:double,key:string>>")
    assert [(e["offset"], e["key"]) for e in df.select(R.merge_close(F.col("e")).alias("e")).first()["e"]] == [(0.3, "c"), (2.0, None)]


def grid(spark, heights, half=10.0):
    n = int(len(heights) ** 0.5)
    rows = [(1, r, c, -half + c * 2 * half / (n - 1), -half + r * 2 * half / (n - 1), float(heights[r * n + c])) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "seed_id int, row int, col int, x double, z double, height double")


def test_elevation_is_bilinear_and_clamped(spark):
    got = E.elevation_at(points(spark, (0, 0), (-10, -10), (20, 20)), grid(spark, [0, 10, 20, 30])).orderBy("point").collect()
    assert [r["y"] for r in got] == [15, 0, 30]
    other = points(spark, (0, 0)).withColumn("seed_id", F.lit(2))
    assert E.elevation_at(other, grid(spark, [0, 10, 20, 30])).first()["y"] == 0


def test_pose_on_a_plane(spark):
    heights = [0.2 * (-10 + r * 2) + 0.1 * (-10 + c * 2) for r in range(11) for c in range(11)]
    car = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], "seed_id int, event_id int, x double, z double, heading double")
    got = E.ground_pose(car, grid(spark, heights), 4.0, 2.0).first()
    assert got["pitch"] == pytest.approx(math.atan2(0.8, 4)) and got["roll"] == pytest.approx(math.atan2(0.2, 2))


def test_tin_sample(spark):
    tri = [(1, 0, 0.0, 0.0, 0.0, 10.0, 2.0, 0.0, 0.0, 4.0, 10.0), (1, 1, 10.0, 2.0, 0.0, 10.0, 6.0, 10.0, 0.0, 4.0, 10.0)]
    t = spark.createDataFrame(tri, "seed_id int, tri int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    got = {r["point"]: (r["y"], r["how"]) for r in E.sample_tin(points(spark, (5, 5), (12, 12), (300, 300)), t).collect()}
    assert got[0] == (3.0, "inside") and got[1] == (6.0, "vertex") and got[2] == (None, "missed")


def test_ring_measures_and_cleaning(spark):
    rings = B.rings(square(spark))
    assert abs(B.polygon_measures(rings).first()["area"]) == 100.0
    assert B.clean_rings(rings).select(F.size("ring")).first()[0] == 4
    assert B.clean_rings(B.rings(square(spark, 0.01))).select(F.size("ring")).first()[0] == 0


def test_osm_polygons_and_layers(spark):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    rows = [("way", 1, {"building": "office"}, ring, None), ("relation", 2, {"natural": "water"}, None, [("way", "outer", 1, ring), ("way", "inner", 2, ring), ("node", "outer", 3, ring)]), ("way", 3, {"highway": "footway"}, ring[:2], None), ("node", 4, {}, None, None)]
    df = spark.createDataFrame(rows, files.ELEMENTS)
    got = O.polygons(O.classify(df)).orderBy("id").select("layer", "kind", F.size("polygons"), F.size(F.get("polygons", 0)[0])).collect()
    assert [tuple(r) for r in got[:2]] == [("building", "office", 1, 4), ("area", "water", 1, 4)] and got[2][:3] == ("road", "footway", 0) and got[3]["layer"] is None
    assert O.select_tagged(df).count() == 3


def test_sources_of_files(spark, tmp_path, seeds):
    (tmp_path / "osm.json").write_text('{"type":"way","id":1,"tags":{"highway":"primary"},"geometry":[{"lat":1,"lon":2}]}\n{"type":"node","id":2,"tags":{}}\n')
    assert files.read_osm_elements(spark, str(tmp_path / "osm.json")).count() == 1
    lists = ["35 139 5 35 139.001 5 35.001 139.001 5", "35 139 17 35 139.001 17 35.001 139.001 17"]
    ring = lambda s: f"<gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{s}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface>"
    body = f'<bldg:boundedBy><bldg:GroundSurface><bldg:lod2MultiSurface>{ring(lists[0])}</bldg:lod2MultiSurface></bldg:GroundSurface></bldg:boundedBy><bldg:boundedBy><bldg:RoofSurface><bldg:lod2MultiSurface>{ring(lists[1])}</bldg:lod2MultiSurface></bldg:RoofSurface></bldg:boundedBy>'
    (tmp_path / "a.gml").write_text(f'<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g"><core:cityObjectMember><bldg:Building gml:id="B1"><gml:name>n</gml:name>{body}</bldg:Building></core:cityObjectMember></core:CityModel>')
    parsed = files.read_citygml(spark, str(tmp_path / "a.gml"))
    built, surfaces = files.citygml_buildings(parsed)
    b = built.first()
    assert (b["building"], b["lod"], b["height"], b["n_surfaces"], b["n_footprints"]) == ("B1", 2, 12.0, 2, 1)
    assert {r["kind"] for r in surfaces.collect()} == {"ground", "roof"}
    assert files.citygml_summary(parsed, built).first()["skipped"] == 0


def test_building_tiles(spark, tmp_path, seeds):
    ring = [(139.767, 35.681), (139.7672, 35.681), (139.767, 35.6812)]
    rows = [("in", "n", 3.0, None, "office", ring), ("out", "m", 3.0, None, "office", [(139.9, 35.9)] * 3)]
    df = spark.createDataFrame(rows, "id string, name string, height double, levels double, kind string, ring array<struct<lon:double,lat:double>>")
    tiled = df.withColumn("tile_x", T.geo.tile_x(F.col("ring")[0]["lon"], 14)).withColumn("tile_y", T.geo.tile_y(F.col("ring")[0]["lat"], 14)).withColumn("ordinal", F.lit(0))
    tiled.write.partitionBy("tile_x", "tile_y").parquet(str(tmp_path / "b"))
    found = files.read_buildings(spark, str(tmp_path / "b"), seeds)
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString()
    # the files of other tiles are not even opened
    lost = [f for f in (tmp_path / "b").rglob("*.parquet") if "tile_x=14552" not in str(f)]
    assert len(lost) == 1
    lost[0].write_bytes(b"not a table")
    assert [r["id"] for r in found.collect()] == ["in"]


def test_elevation_tiles(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    pixels = [bytes([0, 137, 219, 68, 128, 0, 0]), bytes([0, 128, 1, 0, 128, 0, 128])]
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(pixels))) + chunk(b"IEND", b"")
    (tmp_path / "14" / "5").mkdir(parents=True)
    (tmp_path / "14" / "5" / "7.png").write_bytes(png)
    got = {(r["tile_x"], r["tile_y"], r["px"], r["py"]): r["elevation"] for r in files.read_elevation_tiles(spark, str(tmp_path)).collect()}
    assert got == {(5, 7, 0, 0): 2523.265625, (5, 7, 1, 0): 0.0, (5, 7, 0, 1): 1.0, (5, 7, 1, 1): 0.5}


def test_demo_city(spark, seeds):
    assert demo.demo_buildings(seeds).count() > 100 and demo.demo_roads(seeds).count() > 20
    assert {r["kind"] for r in demo.demo_areas(seeds).collect()} == {"park", "water"}


def test_cache_expiry(spark):
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    kept = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 2)), ("b", 2, dt.datetime(2023, 12, 31))], "key string, value int, expires_at timestamp")
    hits, misses = cache.load_missing(req, kept, F.lit(dt.datetime(2024, 1, 1)))
    assert [r["key"] for r in hits.collect()] == ["a"] and {r["key"] for r in misses.collect()} == {"b", "c"}


def test_export_keeps_the_origin_out(spark, seeds):
    assert W.privacy_safe(seeds).columns == ["seed_id", "radius", "exact_origin_included"]
    assert W.world_metadata(seeds).first()["origin_lon"] is None and W.world_metadata(seeds, True).first()["origin_lon"] == 139.767125
    with pytest.raises(Exception, match="no map data"):
        none = seeds.where("false").select("seed_id")
        W.require_data(W.source_choices(seeds, none, none, none, none)).collect()
    m = spark.createDataFrame([({"a": "1", "b": None},)], "properties map<string,string>")
    assert W.compact_properties(m).first()["properties"] == {"a": "1"}


def test_manifest_writes(spark, tmp_path):
    o = spark.createDataFrame([(1, "building:a", "0:0"), (2, "building:b", "1:0")], "seed_id int, object_id string, tile string")
    path, rows = str(tmp_path / "m"), lambda: sorted(map(tuple, W.read_manifest(spark, str(tmp_path / "m")).select("seed_id", "object_id", "tile").collect()))
    W.write_manifest(o, path)
    assert rows() == [(1, "building:a", "0:0"), (2, "building:b", "1:0")]
    W.write_manifest(o, path)
    assert rows() == [(1, "building:a", "0:0"), (2, "building:b", "1:0")]
    # another write of one seed replaces that seed alone
    W.write_manifest(spark.createDataFrame([(2, "building:c", "2:0"), (2, "building:d", "2:0")], o.schema), path)
    assert rows() == [(1, "building:a", "0:0"), (2, "building:c", "2:0"), (2, "building:d", "2:0")]
    # a write that stopped before its header is not read; one that lost rows is noticed
    W._write_by_seed(spark.createDataFrame([(3, "building:e", "0:0")], o.schema), f"{path}/objects")
    assert len(rows()) == 3
    W._write_by_seed(spark.createDataFrame([(2, "building:c", "2:0")], o.schema), f"{path}/objects")
    with pytest.raises(ValueError, match="header"):
        rows()


MS = [0, 1000, 2499, 2500, 3000, 5000]


def requests(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=m)) for i, m in enumerate(MS)]
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")


def test_cooldown(spark):
    assert [r["event_id"] for r in M.cooldown_batch(requests(spark)).where("accepted").orderBy("event_id").collect()] == [0, 3, 5]


def run_stream(spark, df, build, tmp_path, name, watermark="1 minute"):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream = stream.withWatermark("ts", watermark) if watermark else stream
    return run.append(build(stream), str(tmp_path / "out"))


def test_cooldown_stream(spark, tmp_path):
    got = run_stream(spark, requests(spark), M.cooldown_stream, tmp_path, "cooled")
    assert sorted(r["event_id"] for r in got.collect()) == [0, 3, 5]


def test_active_tiles_stream(spark, tmp_path):
    df = requests(spark).withColumn("signature", F.when(F.col("event_id") < 3, "a").otherwise("b"))
    got = run_stream(spark, df, M.active_tiles_stream, tmp_path, "tiles")
    assert sorted(r["event_id"] for r in got.collect()) == [0, 3]


def drives(spark):
    xs = [(0.0, 0.0), (0.0, 2.0), (50.0, 2.0), (100.0, 2.0)]
    rows = [(1, i, dt.datetime(2024, 1, 1, 0, 0, i), x, 0.0, s) for i, (x, s) in enumerate(xs)]
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, x double, z double, speed double")


ROUTE = [(0.0, 0.0), (50.0, 0.0), (100.0, 0.0)]


def test_challenge(spark, tmp_path):
    route = spark.createDataFrame([(1, ROUTE)], "user_id long, route array<struct<x:double,z:double>>")
    want = [(0, "ready", 0.0, 1), (1, "running", 1.0, 1), (2, "running", 2.0, 2), (3, "finished", 3.0, 2)]
    got = M.challenge_batch(drives(spark), route).orderBy("event_id").collect()
    assert [tuple(r)[1:] for r in got] == want
    stream = run_stream(spark, drives(spark).join(route, "user_id"), M.challenge_stream, tmp_path, "drive")
    assert sorted(tuple(r)[1:] for r in stream.collect()) == want


def test_suppressed_repeats(spark, tmp_path):
    df = requests(spark).withColumn("key", F.lit("k"))
    q = run_stream(spark, df, M.suppress_repeats, tmp_path, "once", watermark=None)
    assert q.count() == 1


def test_sampling_stream(spark, tmp_path):
    df = requests(spark).withColumns({c: F.lit(1.0) for c in ("x", "z", "speed")})
    assert M.sample_telemetry(df).count() == 6 and M.sample_telemetry(df, "1 second").count() == 5
