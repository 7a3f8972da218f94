"""Operators whose keys, cells or paths may hold any share of the rows, against brute force with small chunks and cells."""

import math
import random

import pytest

from geoloom.operators import roads as R
from geoloom.operators import scan, spatial as S, streets as X
from geoloom.streaming.telemetry import PROGRESS, drive_step

EDGES = "seed_id int, edge string, ord int, entry int, ax double, az double, bx double, bz double"
POINTS = "seed_id int, point int, x double, z double"


def distance(x, z, e):
    ax, az, bx, bz = e[4:]
    square = (bx - ax) ** 2 + (bz - az) ** 2
    t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / square)) if square else 0.0
    return math.hypot(x - ax - t * (bx - ax), z - az - t * (bz - az))


def city(seed=5):
    """Long and short edges, one spot with a third of both edges and points, far points, ties, a seed without roads, nulls."""
    rnd = random.Random(seed)
    edges = []
    for i in range(240):
        x, z, reach = (rnd.gauss(40, 3), rnd.gauss(-40, 3), 6) if i % 3 == 0 else (rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice([5, 40, 700]))
        edges.append((i % 2, f"e{i}", i // 4, i % 4, x, z, x + rnd.uniform(-reach, reach), z + rnd.uniform(-reach, reach)))
    edges += [(0, "dot", 900, 0, 9.0, 9.0, 9.0, 9.0), (0, "twin", 901, 0, 9.0, 9.0, 9.0, 9.0)]
    spots = [(i % 2, *((rnd.gauss(40, 2), rnd.gauss(-40, 2)) if i % 3 == 0 else (rnd.uniform(-600, 600), rnd.uniform(-600, 600)))) for i in range(150)]
    spots += [(0, 9.0, 9.0), (0, 50_000.0, 3.0), (1, 51_000.0, 8.0), (7, 1.0, 1.0), (0, None, 1.0)]
    return edges, [(s, i, x, z) for i, (s, x, z) in enumerate(spots)]


@pytest.mark.parametrize("small", [False, True])
def test_nearest_road_on_clusters(spark, monkeypatch, small):
    if small:
        for name, value in (("CELL_EDGES", 4), ("HELD_EDGES", 5), ("HELD_POINTS", 3)):
            monkeypatch.setattr(S, name, value)
    edges, spots = city()
    got = {r["point"]: r for r in S.nearest_road(spark.createDataFrame(spots, POINTS), spark.createDataFrame(edges, EDGES), pad=8.0).collect()}
    assert set(got) == {p[1] for p in spots}
    for s, p, x, z in spots:
        if s == 7 or x is None:
            assert got[p]["edge"] is None and got[p]["distance"] is None
            continue
        best = min((distance(x, z, e), e[2], e[3], e[1]) for e in edges if e[0] == s)
        assert got[p]["distance"] == pytest.approx(best[0]) and (got[p]["edge"] == best[3] or best[0] > 0)


def test_nearest_road_of_an_index(spark):
    edges, spots = city()
    cell = lambda v: math.floor(v / 72)

    def ring(x, z, e):
        (x0, x1), (z0, z1) = (sorted((cell(e[a]), cell(e[b]))) for a, b in ((4, 6), (5, 7)))
        return min(max(x0 - cell(x), cell(x) - x1, z0 - cell(z), cell(z) - z1, 0), 3)

    got = {r["point"]: r["distance"] for r in S.nearest_road_indexed(spark.createDataFrame(spots, POINTS), spark.createDataFrame(edges, EDGES)).collect()}
    for s, p, x, z in spots:
        near = [(ring(x, z, e), distance(x, z, e)) for e in edges if e[0] == s] if x is not None else []
        assert got[p] == (pytest.approx(min(near)[1]) if near else None)


def test_nearest_road_broadcasts_no_edges(spark):
    edges, spots = city()
    plan = S._nearest_in_cells(spark.createDataFrame(spots, POINTS), spark.createDataFrame(edges, EDGES), "point", 8.0)._jdf.queryExecution().executedPlan().toString()
    # a broadcast has a seed's cells alone, never what an edge was exploded to
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = next((k for k in range(i + 1, len(lines)) if len(lines[k]) - len(lines[k].lstrip(" :+-")) <= depth), len(lines))
            assert not any("Generate" in x for x in lines[i:below])
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan


def test_nearest_road_of_nothing(spark):
    edges, spots = city()
    none = S.nearest_road(spark.createDataFrame(spots, POINTS), spark.createDataFrame([], EDGES)).collect()
    assert len(none) == len(spots) and all(r["edge"] is None for r in none)
    assert S.nearest_road(spark.createDataFrame([], POINTS), spark.createDataFrame(edges, EDGES)).collect() == []


# folds and running sums in chunks


def events(seed=3):
    """A key with a third of all rows, many small keys, rows at the same time, a null key."""
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        key = 1 if i % 3 == 0 else rnd.randint(2, 40)
        rows.append((key, i, rnd.randint(0, 4000), rnd.uniform(0, 12), rnd.uniform(0, 12), rnd.choice([0.0, 0.5, 3.0])))
    return [*rows, (None, 9000, 5, 0.0, 0.0, 0.0)]


def by_key(rows):
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("gap", [0, 1, 70, 900, 10_000])
def test_accepting_in_chunks(spark, gap):
    want = {}
    for rows in by_key(events()).values():
        last = None
        for r in rows:
            want[r[1]] = last is None or r[2] - last >= gap
            last = r[2] if want[r[1]] else last
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in events()], "k long, e long, at long")
    assert {r["e"]: r["accepted"] for r in scan.segmented(df, "k", ["at", "e"], "e", scan.Accept(gap), bits=3).collect()} == want


def test_smoothing_in_chunks(spark):
    want = {}
    for rows in by_key(events()).values():
        t = cur = None
        for r in rows:
            cur = r[3] if cur is None else cur + (r[3] - cur) * (1 - math.exp(-max(0.0, r[2] / 900 - t) * 0.7))
            t = r[2] / 900
            want[r[1]] = cur
    df = spark.createDataFrame([(r[0], r[1], r[2] / 900, r[3]) for r in events()], "k long, e long, t double, value double")
    assert {r["e"]: r["smooth"] for r in scan.segmented(df, "k", ["t", "e"], "e", scan.Smooth(0.7), bits=3).collect()} == pytest.approx(want)


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_driving_in_chunks(spark, bits):
    route, want = [(0.0, 0.0), (2.0, 9.0), (9.0, 18.0), (14.0, 14.0), (0.0, 1.0)], {}
    for rows in by_key(events()).values():
        drive, last = ("ready", 0.0, 1), None
        for r in rows:
            if drive[0] != "finished":
                drive = drive_step(drive, 0.0 if last is None else r[2] - last, r[3], r[4], r[5], route)
            last = r[2]
            want[r[1]] = (drive[0], pytest.approx(drive[1]), min(drive[2], len(route) - 1))
    rx, rz = [p[0] for p in route], [p[1] for p in route]
    df = spark.createDataFrame([(r[0], r[1], float(r[2]), *r[3:], rx, rz) for r in events()], "k long, e long, at double, x double, z double, speed double, rx array<double>, rz array<double>")
    got = {r["e"]: (r["status"], r["elapsed"], r["checkpoint"]) for r in scan.segmented(df, "k", ["at", "e"], "e", scan.Drive(), bits=bits).collect()}
    assert got == want and {w[0] for w in want.values()} == {"ready", "running", "finished"} and PROGRESS


def test_folds_of_nothing(spark):
    df = spark.createDataFrame([], "k long, e long, at long")
    assert scan.segmented(df, "k", ["at", "e"], "e", scan.Accept(5)).collect() == []


@pytest.mark.parametrize("cap", [None, 0, 1, 40, 10_000])
def test_running_sums_in_chunks(spark, cap):
    want = {}
    for rows in by_key(events()).values():
        spent = 0
        for r in rows:
            if cap is None or spent < cap:
                want[r[1]] = spent
            spent += r[2] % 7
    df = spark.createDataFrame([(r[0], r[1], r[2], r[2] % 7) for r in events() if r[0]], "k long, e long, at long, w long")
    assert {r["e"]: r["before"] for r in scan.prefix_sum(df, "k", ["at", "e"], "w", cap=cap, bits=3).collect()} == want


def test_no_window_by_seed_alone(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "seed_id int, ord int, w double")
    plan = X.budget_prefix(df, 5.0, "w", "ord")._jdf.queryExecution().optimizedPlan().toString()
    assert all("__chunk" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))


def test_details_and_crosswalks_share_one_budget(spark):
    """Sidewalks in pairs, dashes one by one, then junctions of five stripes, while less than the cap is spent."""
    rows = [(1, f"r{i}", i, "residential" if i % 3 else "motorway", 7.0 if i % 2 else 4.0) for i in range(8)]
    roads = spark.createDataFrame(rows, "seed_id int, id string, ord int, kind string, width double")
    segments = spark.createDataFrame([(1, f"r{i}", 0, 0.0, 5.0 * i, 10.0 + 9 * (i % 4), 5.0 * i) for i in range(8)], "seed_id int, id string, pos int, ax double, az double, bx double, bz double")
    grid = spark.createDataFrame([(1, r, c, 100.0 * c - 50, 100.0 * r - 50, 2.0) for r in range(2) for c in range(2)], "seed_id int, row int, col int, x double, z double, height double")
    ring = [(0.0, 0.0), (30.0, 0.0), (0.0, 30.0), (30.0, 30.0), (15.0, 60.0)]
    nodes = spark.createDataFrame([(1, f"n{i}", x, z, (i, 0)) for i, (x, z) in enumerate(ring)], "seed_id int, node string, x double, z double, first struct<ord:int,k:int>")
    pairs = [(a, b) for a in range(5) for b in range(a)]
    edges = spark.createDataFrame([(1, f"e{i}", i, 0, f"n{a}", f"n{b}", 6.0) for i, (a, b) in enumerate(pairs)], "seed_id int, edge string, ord int, entry int, from_node string, to_node string, width double")
    for cap in (0, 1, 3, 4, 9, 12, 16, 20, 24, 31, 400):
        spent, laid = 0, 0
        for i in range(8):
            if spent >= cap:
                break
            length, width, kind = 10.0 + 9 * (i % 4), rows[i][4], rows[i][3]
            spent += 2 if kind != "motorway" and width >= 4 else 0
            at = 2.5
            while width >= 6.5 and at < length - 1 and spent < cap:
                spent, at = spent + 1, at + 9
        crossings = 0
        while crossings < 5 and spent + 5 * crossings < cap:
            crossings += 1
        laid = X.sidewalks_and_markings(segments, roads, grid, cap).count()
        told = X.details_spent(segments, roads, cap)
        assert (laid, (told.first() or {"spent": 0})["spent"]) == (spent, spent)
        stripes = X.crosswalks(nodes, edges, told, grid, cap).collect()
        assert {r["node"] for r in stripes} == {f"n{i}" for i in range(crossings)} and len(stripes) == 5 * crossings
        assert all(r["ay"] == pytest.approx(2.23) for r in stripes)


def test_places_along_paths(spark):
    rnd = random.Random(9)
    paths = {f"p{i}": [(rnd.uniform(0, 9), rnd.uniform(0, 9)) for _ in range(rnd.randint(2, 9))] for i in range(30)}
    paths["same"] = [(1.0, 1.0), (1.0, 1.0), (2.0, 1.0), (2.0, 1.0), (4.0, 1.0)]
    fractions = [(p, f) for p in paths for f in (-1.0, 0.0, 0.25, 1 / 3, 0.5, 1.0, 7.0)]
    want = {}
    for p, f in fractions:
        offs = [0.0]
        for a, b in zip(paths[p], paths[p][1:]):
            offs.append(offs[-1] + math.dist(a, b))
        target = max(0.0, min(1.0, f)) * offs[-1]
        i = next(i for i in range(1, len(offs)) if offs[i] >= target)
        share = (target - offs[i - 1]) / max(0.001, offs[i] - offs[i - 1])
        want[p, f] = pytest.approx(tuple(a + (b - a) * share for a, b in zip(paths[p][i - 1], paths[p][i])))
    vertices = spark.createDataFrame([(1, p, k, x, z) for p, v in paths.items() for k, (x, z) in enumerate(v)], "seed_id int, id string, pos int, x double, z double")
    asked = spark.createDataFrame([(1, p, f) for p, f in [*fractions, ("none", 0.5)]], "seed_id int, id string, fraction double")
    assert {(r["id"], r["fraction"]): (r["x"], r["z"]) for r in R.locate_along(R.cumulative_offsets(vertices), asked).collect()} == want


# rings


def rings(seed=4):
    """Stars of many corners, boxes along cells' borders, a ring with a third of all edges, a flat one."""
    rnd = random.Random(seed)

    def star(x, z, n, low, high):
        r = [rnd.uniform(low, high) for _ in range(n)]
        return [(x + r[i] * math.cos(2 * math.pi * i / n), z + r[i] * math.sin(2 * math.pi * i / n)) for i in range(n)]

    out = {"big": star(0, 0, 400, 30, 60), "box": [(-20, -20), (20, -20), (20, 20), (-20, 20)], "flat": [(0, 5), (30, 5), (60, 5)], "point": [(3, 3)]}
    return {k: [*v, v[0]] for k, v in (out | {f"s{i}": star(rnd.uniform(-90, 90), rnd.uniform(-90, 90), rnd.randint(3, 30), 2, 40) for i in range(25)}).items()}


def inside(x, z, ring):
    return sum(((az > z) != (bz > z)) and x < (bx - ax) * (z - az) / (bz - az) + ax for (ax, az), (bx, bz) in zip(ring, ring[1:])) % 2 == 1


@pytest.mark.parametrize("size", [3.0, 10.0, 40.37, 1000.0])
def test_points_in_rings(spark, size):
    rnd = random.Random(8)
    spots = [(rnd.uniform(-120, 120), rnd.uniform(-120, 120)) for _ in range(300)] + [(float(rnd.randint(-25, 25)), float(rnd.randint(-25, 25))) for _ in range(100)]
    made = rings()
    vertices = spark.createDataFrame([(1, k, i, float(x), float(z)) for k, v in made.items() for i, (x, z) in enumerate(v)], "seed_id int, id string, pos int, x double, z double")
    points = spark.createDataFrame([(1, i, x, z) for i, (x, z) in enumerate([*spots, (None, 1.0)])], POINTS)
    got = S.point_in_polygon(points, vertices, size=size).collect()
    want = {(i, k) for i, (x, z) in enumerate(spots) for k, v in made.items() if inside(x, z, v)}
    assert len(got) == len(want) and {(r["point"], r["id"]) for r in got} == want
    world = spark.createDataFrame([(1, 0.0, 0.0, 100.0)], "seed_id int, lon double, lat double, radius double")
    clear = {i for i, (x, z) in enumerate(spots) if math.hypot(x, z) <= 98 and not any(inside(x, z, v) or min(distance(x, z, (0, 0, 0, 0, *a, *b)) for a, b in zip(v, v[1:])) < 2 for v in made.values())}
    assert {r["point"] for r in S.can_occupy(points, vertices, world, 2.0, size=size).collect()} == clear


def test_a_large_ring_costs_its_edges_and_cells(spark):
    n = 20_000
    ring = spark.range(n + 1).selectExpr("1 AS seed_id", "'r' AS id", "CAST(id AS INT) AS pos", f"500 * cos(2 * pi() * id / {n}) AS x", f"500 * sin(2 * pi() * id / {n}) AS z")
    listed, inner = S._ring_cells(ring, 0.0, 40.37)
    assert listed.count() < 1.2 * n and 350 < inner.count() < 500
