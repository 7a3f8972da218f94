"""Queries of terrain, the world's objects, exports, telemetry."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.resolve import terrarium
from ..operators import buildings as B
from ..operators import roads as R
from ..operators import spatial as S
from ..operators import streets as X
from ..operators import terrain as E
from ..operators import tiling as T
from ..operators import world as W
from ..operators.storage import durable
from ..sources import files as I
from ..streaming import telemetry as M
from .queries_roads import BUILT, EPN, NEAREST, built, entry_graph, placed_edges
from .registry import DEG, RAD, elev, query, r, rd, rounded, with_


@query("a7_demo_elevation", with_("grid") + f"SELECT seed_id, row, col, {rd('height')} AS height FROM grid")
def _(t):
    return t.grid().select("seed_id", "row", "col", r("height"))


PTS = "pts AS (SELECT seed_id, event_id AS point, x, z FROM telemetry)"


@query("c8_elevation_at", with_("grid", "telemetry", more=PTS) + f"SELECT point, {rd('y')} AS y FROM ({elev('pts')})")
def _(t):
    return E.elevation_at(t.positions().select("seed_id", "point", "x", "z"), t.grid()).select("point", r("y"))


def pixels(t):
    """Elevation pixels of the tiles that the road vertices stand in: byte values from the vertices' keys."""
    v = t["road_vertices"].select(T.geo.tile_x(F.col("lon"), 14).alias("tile_x"), T.geo.tile_y(F.col("lat"), 14).alias("tile_y")).distinct().where("(tile_x + tile_y) % 7 <> 0")
    cells = v.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return cells.withColumn("elevation", terrarium(F.lit(128), (F.col("px") * 11 + F.col("tile_x")) % 256, (F.col("py") * 7 + F.col("tile_y")) % 256))


@query("c9_sample_tile_mosaic", with_("road_vertices", more=f"""g AS (SELECT id, pos, lon, lat, (lon + 180) / 360 * 16384 * 16 AS gx, (1 - asinh(tan(lat * {DEG})) / pi()) / 2 * 16384 * 16 AS gy FROM road_vertices),
f AS (SELECT *, floor(gx / 16) AS tx, floor(gy / 16) AS ty FROM g), h AS (SELECT *, greatest(0, least(15, gx - tx * 16)) AS fx, greatest(0, least(15, gy - ty * 16)) AS fy FROM f),
e AS (SELECT *, least(15, floor(fx)) AS x0, least(15, floor(fx) + 1) AS x1, least(15, floor(fy)) AS y0, least(15, floor(fy) + 1) AS y1, fx - floor(fx) AS wx, fy - floor(fy) AS wy FROM h)""") + f"SELECT id, pos, (tx + ty) % 7 = 0 AS missing, CASE WHEN (tx + ty) % 7 <> 0 THEN {rd('(1 - wx) * (1 - wy) * (((x0 * 11 + tx) % 256) + ((y0 * 7 + ty) % 256) / 256) + wx * (1 - wy) * (((x1 * 11 + tx) % 256) + ((y0 * 7 + ty) % 256) / 256) + (1 - wx) * wy * (((x0 * 11 + tx) % 256) + ((y1 * 7 + ty) % 256) / 256) + wx * wy * (((x1 * 11 + tx) % 256) + ((y1 * 7 + ty) % 256) / 256)', 3)} END AS elevation FROM e")
def _(t):
    return E.sample_mosaic(t["road_vertices"].select("id", "pos", "lon", "lat"), pixels(t), 14, 16).select("id", "pos", "missing", r("elevation", 3))


def tin(t):
    """Two triangles for every second row and column of the demo grid, those of some cells left out."""
    g = t.grid().where("row % 2 = 0 and col % 2 = 0")
    at = lambda p, dr, dc: g.select("seed_id", (F.col("row") - 2 * dr).alias("row"), (F.col("col") - 2 * dc).alias("col"), F.col("x").alias(f"{p}x"), F.col("height").alias(f"{p}y"), F.col("z").alias(f"{p}z"))
    k = ["seed_id", "row", "col"]
    cells = at("a", 0, 0).join(at("b", 0, 1), k).join(at("c", 1, 0), k).join(at("d", 1, 1), k).where("(row + col) % 6 <> 0")
    corner = lambda p, q: [F.col(f"{p}{c}").alias(f"{q}{c}") for c in "xyz"]
    one = cells.select("seed_id", (F.col("row") * 100 + F.col("col")).alias("tri"), *corner("a", "a"), *corner("b", "b"), *corner("c", "c"))
    two = cells.select("seed_id", (F.col("row") * 100 + F.col("col") + 1).alias("tri"), *corner("b", "a"), *corner("d", "b"), *corner("c", "c"))
    return one.unionByName(two)


TIN = """cell AS (SELECT a.seed_id, a.row, a.col, a.x AS ax, a.height AS ay, a.z AS az, b.x AS bx, b.height AS by_, b.z AS bz, c.x AS cx, c.height AS cy, c.z AS cz, d.x AS dx, d.height AS dy, d.z AS dz FROM grid a JOIN grid b ON b.seed_id = a.seed_id AND b.row = a.row AND b.col = a.col + 2 JOIN grid c ON c.seed_id = a.seed_id AND c.row = a.row + 2 AND c.col = a.col JOIN grid d ON d.seed_id = a.seed_id AND d.row = a.row + 2 AND d.col = a.col + 2 WHERE a.row % 2 = 0 AND a.col % 2 = 0 AND (a.row + a.col) % 6 <> 0),
tri AS (SELECT seed_id, row * 100 + col AS tri, ax, ay, az, bx, by_, bz, cx, cy, cz FROM cell UNION ALL SELECT seed_id, row * 100 + col + 1, bx, by_, bz, dx, dy, dz, cx, cy, cz FROM cell),
bary AS (SELECT p.point, t.*, ((bz - cz) * (p.x - cx) + (cx - bx) * (p.z - cz)) / ((bz - cz) * (ax - cx) + (cx - bx) * (az - cz)) AS u, ((cz - az) * (p.x - cx) + (ax - cx) * (p.z - cz)) / ((bz - cz) * (ax - cx) + (cx - bx) * (az - cz)) AS v FROM pts p JOIN tri t ON t.seed_id = p.seed_id),
hit AS (SELECT point, arg_min(u * ay + v * by_ + (1 - u - v) * cy, tri) AS y FROM bary WHERE u >= -0.0008 AND v >= -0.0008 AND 1 - u - v >= -0.0008 GROUP BY point),
corner AS (SELECT seed_id, tri, 0 AS i, ax AS vx, ay AS vy, az AS vz FROM tri UNION ALL SELECT seed_id, tri, 1, bx, by_, bz FROM tri UNION ALL SELECT seed_id, tri, 2, cx, cy, cz FROM tri),
near AS (SELECT p.point, vy, greatest(abs(floor(vx / 28) - floor(x / 28)), abs(floor(vz / 28) - floor(z / 28))) AS ring, sqrt(pow(vx - x, 2) + pow(vz - z, 2)) AS d, tri, i FROM pts p JOIN corner c ON c.seed_id = p.seed_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY ring, d, tri, i) AS k FROM near WHERE ring <= 1) WHERE k = 1)"""


@query("c10_sample_tin", with_("grid", "telemetry", more=f"{PTS}, {TIN}") + f"SELECT p.point, {rd('coalesce(h.y, b.vy)', 3)} AS y, CASE WHEN h.point IS NOT NULL THEN 'inside' WHEN b.point IS NOT NULL THEN 'vertex' ELSE 'missed' END AS how FROM pts p LEFT JOIN hit h ON h.point = p.point LEFT JOIN best b ON b.point = p.point")
def _(t):
    return E.sample_tin(t.positions().select("seed_id", "point", "x", "z"), tin(t)).select("point", r("y", 3), "how")


@query("c15_draped_strips", with_("grid", "building_vertices", "bseg", more=f"""st AS (SELECT seed_id, concat(id, '/', CAST(pos AS VARCHAR)) AS strip, ax, az, bx, bz, CAST(greatest(1, least(64, ceil(sqrt(pow(bx - ax, 2) + pow(bz - az, 2)) / 5.5e0))) AS INTEGER) AS spans FROM bseg),
pts AS (SELECT seed_id, strip, spans, concat(strip, ':', CAST(k AS VARCHAR)) AS point, ax + (bx - ax) * k / spans AS x, az + (bz - az) * k / spans AS z FROM st, range(65) r(k) WHERE k <= spans), {TIN}""") + f"SELECT p.strip, spans, count(*) AS n_vertices, count(*) FILTER (WHERE h.point IS NULL AND b.point IS NULL) AS n_missed, {rd('min(coalesce(h.y, b.vy)) + 0.14e0', 3)} AS min_y, {rd('max(coalesce(h.y, b.vy)) + 0.14e0', 3)} AS max_y FROM pts p LEFT JOIN hit h ON h.point = p.point LEFT JOIN best b ON b.point = p.point GROUP BY p.strip, spans")
def _(t):
    strips = R.path_segments(t.rings()).select("seed_id", F.concat_ws("/", "id", "pos").alias("strip"), "ax", "az", "bx", "bz")
    return E.draped_strips(strips, tin(t)).select("strip", "spans", "n_vertices", "n_missed", r("min_y", 3), r("max_y", 3))


@query("d7_grid_summary", with_("grid") + f"SELECT g.seed_id, count(*) AS n_samples, {rd('any_value(o.height)')} AS origin, {rd('min(g.height) - any_value(o.height)')} AS min_height, {rd('max(g.height) - any_value(o.height)')} AS max_height FROM grid g JOIN grid o ON o.seed_id = g.seed_id AND o.row = 16 AND o.col = 16 GROUP BY g.seed_id")
def _(t):
    return rounded(E.grid_summary(t.grid()), "origin", "min_height", "max_height")


def _tin_pixels(t):
    """Sparse pixels (16 a side) of every tile of the seeds' boxes, for G6."""
    tiles = T.tiles_for_bounds(T.bounds_around(t.seeds)).select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y")).distinct()
    cells = tiles.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return cells.withColumn("elevation", (F.col("px") * 11 + F.col("py") * 7 + F.col("tile_x") % 50 + F.col("tile_y") % 30).cast("double"))


N_SQL = "CASE WHEN radius <= 300 THEN 65 WHEN radius <= 600 THEN 129 ELSE 257 END"


@query("g6_terrain_grid", with_("seeds", more=f"""n AS (SELECT *, {N_SQL} AS n FROM seeds), p AS (SELECT seed_id, n, i AS row, j AS col, lon + (-radius + j * (2 * radius / (n - 1))) / ({RAD} * cos(lat * {DEG})) / {DEG} AS lon, lat - (-radius + i * (2 * radius / (n - 1))) / {RAD} / {DEG} AS lat FROM n, range(257) a(i), range(257) b(j) WHERE i < n AND j < n),
g AS (SELECT *, (lon + 180) / 360 * 16384 * 16 AS gx, (1 - asinh(tan(lat * {DEG})) / pi()) / 2 * 16384 * 16 AS gy FROM p), f AS (SELECT *, floor(gx / 16) AS tx, floor(gy / 16) AS ty FROM g), h AS (SELECT *, greatest(0, least(15, gx - tx * 16)) AS fx, greatest(0, least(15, gy - ty * 16)) AS fy FROM f),
e AS (SELECT *, least(fx, 15) * 11 + least(fy, 15) * 7 + tx % 50 + ty % 30 AS height FROM h)""") + f"SELECT e.seed_id, CAST(e.row AS INTEGER) AS row, CAST(e.col AS INTEGER) AS col, {rd('e.height - o.height', 3)} AS height FROM e JOIN e o ON o.seed_id = e.seed_id AND o.row = e.n // 2 AND o.col = e.n // 2")
def _(t):
    return E.terrain_grid(t.seeds, _tin_pixels(t), 14, 16).select("seed_id", "row", "col", r("height", 3))


RADIAL = """pts AS (SELECT seed_id, 0 AS point, 0e0 AS x, 0e0 AS z FROM seeds UNION ALL SELECT seed_id, CAST(1 + (a - 1) * 32 + b AS INTEGER), cos(b * (2 * pi() / 32)) * (radius * a / 12), sin(b * (2 * pi() / 32)) * (radius * a / 12) FROM seeds, range(1, 13) r(a), range(32) s(b))"""


def radial(t):
    v = E.radial_terrain(t.seeds, 32, 12)
    return E.elevation_at(v, t.grid())


MESH = f"""ms AS (SELECT seed_id, radius, greatest(2e0, 2 * radius / ({N_SQL} - 1)) AS res FROM seeds),
mp AS (SELECT seed_id, radius, CAST(greatest(32, least(128, ceil(radius / greatest(6e0, res * 1.15e0)))) AS INTEGER) AS rings, CAST(greatest(128, least(384, ceil(ceil(2 * pi() * radius / greatest(10e0, res * 1.7e0)) / 32) * 32)) AS INTEGER) AS sectors FROM ms),
pts AS (SELECT seed_id, 0 AS point, 0e0 AS x, 0e0 AS z FROM seeds UNION ALL SELECT seed_id, CAST(1 + (a - 1) * sectors + b AS INTEGER), cos(b * (2 * pi() / sectors)) * (radius * a / rings), sin(b * (2 * pi() / sectors)) * (radius * a / rings) FROM mp, range(1, 129) r(a), range(384) s(b) WHERE a <= rings AND b < sectors)"""


@query("g7_radial_terrain", with_("grid", more=MESH) + f"SELECT seed_id, point, {rd('x', 3)} AS x, {rd('z', 3)} AS z, {rd('y', 3)} AS y FROM ({elev('pts')})")
def _(t):
    return rounded(E.elevation_at(E.radial_terrain(t.seeds), t.grid()).select("seed_id", "point", "x", "z", "y"), "x", "z", "y", digits=3)


@query("g8_terrain_triangles", with_("seeds", more="m AS (SELECT seed_id, CAST(least(128, greatest(32, radius / 10)) AS INTEGER) AS rings FROM seeds), s AS (SELECT *, k * 2 AS sector FROM m, range(64) r(k)), kept AS (SELECT seed_id, ring, row_number() OVER (PARTITION BY seed_id ORDER BY ring) AS n FROM (SELECT DISTINCT seed_id, CASE WHEN k = 0 THEN rings ELSE k * 2 END AS ring FROM m, range(70) r(k) WHERE k * 2 <= rings)), pairs AS (SELECT a.seed_id, a.ring AS inner_ring, b.ring AS outer_ring FROM kept a JOIN kept b ON b.seed_id = a.seed_id AND b.n = a.n + 1)") + """SELECT seed_id, count(*) AS n, sum(a * 3 + b * 5 + c * 7)::BIGINT AS mix FROM (
SELECT s.seed_id, 0 AS a, 1 + (ring - 1) * 128 + (sector + 2) % 128 AS b, 1 + (ring - 1) * 128 + sector AS c FROM s JOIN kept k ON k.seed_id = s.seed_id AND n = 1
UNION ALL SELECT s.seed_id, 1 + (inner_ring - 1) * 128 + sector, 1 + (outer_ring - 1) * 128 + (sector + 2) % 128, 1 + (outer_ring - 1) * 128 + sector FROM s JOIN pairs p ON p.seed_id = s.seed_id
UNION ALL SELECT s.seed_id, 1 + (inner_ring - 1) * 128 + sector, 1 + (inner_ring - 1) * 128 + (sector + 2) % 128, 1 + (outer_ring - 1) * 128 + (sector + 2) % 128 FROM s JOIN pairs p ON p.seed_id = s.seed_id) GROUP BY seed_id""")
def _(t):
    m = t.seeds.select("seed_id", F.lit(128).alias("sectors"), F.least(F.lit(128), F.greatest(F.lit(32), F.col("radius") / 10)).cast("int").alias("rings"))
    return E.terrain_triangles(m, 2).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * 3 + F.col("b") * 5 + F.col("c") * 7).alias("mix"))


@query("d14_vertex_slope", with_("grid", more=f"""{RADIAL}, v AS (SELECT seed_id, point, x, y, z FROM ({elev('pts')})),
s AS (SELECT k AS sector, ring FROM range(32) r(k), range(1, 13) q(ring)), t AS (SELECT 0 AS a, 1 + (sector + 1) % 32 AS b, 1 + sector AS c FROM s WHERE ring = 1 UNION ALL SELECT 1 + (ring - 2) * 32 + sector, 1 + (ring - 1) * 32 + (sector + 1) % 32, 1 + (ring - 1) * 32 + sector FROM s WHERE ring > 1 UNION ALL SELECT 1 + (ring - 2) * 32 + sector, 1 + (ring - 2) * 32 + (sector + 1) % 32, 1 + (ring - 1) * 32 + (sector + 1) % 32 FROM s WHERE ring > 1),
n AS (SELECT a.seed_id, t.a, t.b, t.c, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz FROM t JOIN v a ON a.point = t.a JOIN v b ON b.seed_id = a.seed_id AND b.point = t.b JOIN v c ON c.seed_id = a.seed_id AND c.point = t.c),
e AS (SELECT seed_id, a AS point, nx, ny, nz FROM n UNION ALL SELECT seed_id, b, nx, ny, nz FROM n UNION ALL SELECT seed_id, c, nx, ny, nz FROM n), g AS (SELECT seed_id, point, degrees(acos(least(1, abs(sum(ny)) / sqrt(pow(sum(nx), 2) + pow(sum(ny), 2) + pow(sum(nz), 2))))) AS slope FROM e GROUP BY seed_id, point), m AS (SELECT seed_id, min(y) AS low, max(y) AS high FROM v GROUP BY seed_id)""") + f"SELECT g.seed_id, CAST(g.point AS INTEGER) AS point, {rd('slope', 3)} AS slope, CASE WHEN least(1, slope / 48) < 0.34 THEN 'cool-moderate' WHEN least(1, slope / 48) < 0.7 THEN 'moderate-steep' ELSE 'steep-cliff' END AS band, {rd('(y - low) / greatest(1, high - low)', 3)} AS relative FROM g JOIN v ON v.seed_id = g.seed_id AND v.point = g.point JOIN m ON m.seed_id = g.seed_id")
def _(t):
    m = t.seeds.select("seed_id", F.lit(32).alias("sectors"), F.lit(12).alias("rings"))
    tri = E.terrain_triangles(m).select("seed_id", "a", "b", "c")
    return E.vertex_slope(tri, durable(radial(t))).select("seed_id", "point", r("slope", 3), "band", r("relative", 3))


@query("j7_ground_pose", with_("grid", "telemetry", more=f"""off AS (SELECT * FROM (VALUES ('c', 0e0, 0e0), ('f', 1.9e0, 0e0), ('b', -1.9e0, 0e0), ('l', 0e0, -1.225e0), ('r', 0e0, 1.225e0)) o(spot, fwd, side)),
pts AS (SELECT seed_id, event_id AS point, spot, x + sin(heading) * fwd + cos(heading) * side AS x, z + cos(heading) * fwd - sin(heading) * side AS z FROM telemetry, off),
y AS (SELECT point, max(y) FILTER (WHERE spot = 'c') AS c, max(y) FILTER (WHERE spot = 'f') AS f, max(y) FILTER (WHERE spot = 'b') AS b, max(y) FILTER (WHERE spot = 'l') AS l, max(y) FILTER (WHERE spot = 'r') AS r FROM ({elev('pts')}) GROUP BY point)""") + f"SELECT point AS event_id, {rd('greatest(-0.62e0, least(0.62e0, atan2(f - b, 3.8e0)))')} AS pitch, {rd('greatest(-0.48e0, least(0.48e0, atan2(r - l, 2.45e0)))')} AS roll, {rd('greatest(c, (f + b + l + r) / 4)')} AS ground FROM y")
def _(t):
    return E.ground_pose(t["telemetry"], t.grid()).select("event_id", r("pitch"), r("roll"), r("ground"))


@query("g13_roof_faces", with_("rr", "bseg", "bbox", more="b5 AS (SELECT seed_id, id, avg(x) AS mean_x, avg(z) AS mean_z FROM bv GROUP BY seed_id, id), f AS (SELECT s.*, rr.rh, rr.rise, rr.profile, b.min_x, b.max_x, b.min_z, b.max_z, m.mean_x, m.mean_z, (b.max_x - b.min_x) >= (b.max_z - b.min_z) AS along FROM bseg s JOIN rr ON rr.seed_id = s.seed_id AND rr.id = s.id JOIN bbox b ON b.seed_id = s.seed_id AND b.id = s.id JOIN b5 m ON m.seed_id = s.seed_id AND m.id = s.id)") + f"""SELECT seed_id, id, pos, profile, {rd("CASE profile WHEN 'skillion' THEN rh - rise + rise * CASE WHEN along THEN (az - min_z) / greatest(max_z - min_z, 0.001e0) ELSE (ax - min_x) / greatest(max_x - min_x, 0.001e0) END WHEN 'flat' THEN rh + 0.025e0 ELSE rh - rise END", 3)} AS ay,
{rd("CASE profile WHEN 'hipped' THEN mean_x WHEN 'gabled' THEN CASE WHEN along THEN (ax + bx) / 2 ELSE (min_x + max_x) / 2 END END", 3)} AS peak_x, {rd("CASE WHEN profile IN ('hipped', 'gabled') THEN rh END", 3)} AS peak_y FROM f""")
def _(t):
    box = t.rings().groupBy("seed_id", "id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("x").alias("mean_x"), F.avg("z").alias("mean_z"))
    out = B.roof_faces(t.resolved().select("seed_id", "id", "resolved_height", "roof_profile", "roof_rise"), R.path_segments(t.rings()), box)
    return out.select("seed_id", "id", "pos", "profile", r("ay", 3), r("peak_x", 3), r("peak_y", 3))


def objects(t):
    """The manifest of buildings, roofs, roads and terrain."""
    box = t.rings().groupBy("seed_id", "id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))
    mid = box.select("seed_id", "id", ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_z") + F.col("max_z")) / 2).alias("z"))
    grid = durable(t.grid())
    b, roofs = W.building_objects(t.resolved().select("seed_id", "id", "kind", "resolved_height", "resolved_min_height", "roof_profile", "roof_rise"), box, E.elevation_at(mid, grid, key="id"))
    points = E.elevation_at(t.road_points(), grid, key="id")
    roads = W.plain_objects(W.road_bounds(W.object_bounds(points), t["road_base"]), "roads", "road", "overture")
    return W.manifest(W.terrain_objects(t.seeds, E.grid_summary(grid)), roads, b, roofs)


BOBJ = f"""mid AS (SELECT *, (min_x + max_x) / 2 AS x, (min_z + max_z) / 2 AS z FROM bbox), bo AS (SELECT m.seed_id, m.id, m.min_x, m.max_x, m.min_z, m.max_z, x, z, y, rh, rmin, rise, profile, kind FROM ({elev('mid')}) m JOIN rr ON rr.seed_id = m.seed_id AND rr.id = m.id),
rp AS (SELECT p.seed_id, p.id, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y FROM ({elev('rv')}) p GROUP BY p.seed_id, p.id),
sm AS (SELECT g.seed_id, s.radius, min(g.height) - any_value(o.height) AS low, max(g.height) - any_value(o.height) AS high FROM grid g JOIN grid o ON o.seed_id = g.seed_id AND o.row = 16 AND o.col = 16 JOIN seeds s ON s.seed_id = g.seed_id GROUP BY g.seed_id, s.radius),
ob AS (SELECT seed_id, concat('building:', id) AS object_id, 'buildings' AS layer, kind, min_x, max_x, min_z, max_z, y + rmin AS min_y, y + rh AS max_y FROM bo UNION ALL SELECT seed_id, concat('roof:', id), 'roofs', profile, min_x, max_x, min_z, max_z, y + rh - rise, y + rh + 0.03e0 FROM bo
UNION ALL SELECT p.seed_id, concat('road:', p.id), 'roads', kind, min_x - width / 2, max_x + width / 2, min_z - width / 2, max_z + width / 2, min_y, max_y + 0.25e0 FROM rp p JOIN road_base r ON r.id = p.id AND r.seed_id = p.seed_id
UNION ALL SELECT seed_id, 'terrain:ground', 'terrain', 'elevation-mesh', -radius, radius, -radius, radius, low, high FROM sm),
ot AS (SELECT *, CASE WHEN layer <> 'terrain' THEN concat(CAST(CAST(floor(((min_x + max_x) / 2 + 150) / 300) AS INTEGER) AS VARCHAR), ':', CAST(CAST(floor(((min_z + max_z) / 2 + 150) / 300) AS INTEGER) AS VARCHAR)) END AS tile FROM ob)"""
OBJ = ("grid", "rr", "bbox", "rv", "road_base")


@query("g5_manifest_objects", with_(*OBJ, more=BOBJ) + f"SELECT seed_id, object_id, layer, kind, {rd('min_x', 3)} AS min_x, {rd('min_y', 3)} AS min_y, {rd('max_z', 3)} AS max_z, {rd('max_y', 3)} AS max_y, {rd('(min_x + max_x) / 2', 3)} AS center_x, tile FROM ot")
def _(t):
    return objects(t).select("seed_id", "object_id", "layer", "kind", r("min_x", 3), r("min_y", 3), r("max_z", 3), r("max_y", 3), r("center_x", 3), "tile")


@query("u2_manifest_union", with_(*OBJ, more=BOBJ) + "SELECT layer, count(*) AS n, count(DISTINCT object_id) AS n_ids FROM ot GROUP BY layer")
def _(t):
    return objects(t).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("object_id").alias("n_ids"))


@query("d5_layer_counts", with_(*OBJ, more=BOBJ) + "SELECT seed_id, count(*) FILTER (WHERE layer = 'terrain') AS terrain, count(*) FILTER (WHERE layer = 'areas') AS areas, count(*) FILTER (WHERE layer = 'roads') AS roads, count(*) FILTER (WHERE layer = 'buildings') AS buildings, count(*) FILTER (WHERE layer = 'roofs') AS roofs FROM ot GROUP BY seed_id")
def _(t):
    return W.layer_counts(objects(t))


@query("d8_object_bounds", with_("rv", "road_base", "grid", more=f"rp AS (SELECT p.seed_id, p.id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM ({elev('rv')}) p GROUP BY p.seed_id, p.id)") + f"SELECT p.seed_id, p.id, {rd('min_x - width / 2', 3)} AS min_x, {rd('max_y + 0.25e0', 3)} AS max_y, {rd('(min_x + max_x) / 2', 3)} AS center_x FROM rp p JOIN road_base r ON r.id = p.id AND r.seed_id = p.seed_id")
def _(t):
    points = E.elevation_at(t.road_points(), t.grid(), key="id")
    return W.road_bounds(W.object_bounds(points), t["road_base"]).select("seed_id", "id", r("min_x", 3), r("max_y", 3), r("center_x", 3))


@query("a12_colliders", with_(*OBJ, more=BOBJ) + f"SELECT seed_id, object_id, {rd('greatest(0.25e0, max_x - min_x)', 3)} AS width, {rd('greatest(0.25e0, max_y - min_y)', 3)} AS height, {rd('(min_z + max_z) / 2', 3)} AS center_z FROM ot WHERE layer = 'buildings'")
def _(t):
    return W.colliders(objects(t)).select("seed_id", "object_id", r("width", 3), r("height", 3), r("center_z", 3))


@query("d10_tile_buckets", with_("bv", "buildings", more="m AS (SELECT seed_id, id, avg(x) AS x, avg(z) AS z FROM bv GROUP BY seed_id, id), p AS (SELECT m.seed_id, m.id, kind, concat(CAST(CAST(floor((x + 150) / 300) AS INTEGER) AS VARCHAR), ':', CAST(CAST(floor((z + 150) / 300) AS INTEGER) AS VARCHAR)) AS tile FROM m JOIN buildings b ON b.id = m.id)") + "SELECT seed_id, tile, kind, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(*) * 5 AS n_parts FROM p GROUP BY seed_id, tile, kind")
def _(t):
    m = t.rings().groupBy("seed_id", "id").agg(F.avg("x").alias("x"), F.avg("z").alias("z"))
    parts = T.world_tile(m).join(t["buildings"].select("id", "kind"), "id").join(t.rings().select("seed_id", "id", "pos"), ["seed_id", "id"])
    return W.tile_buckets(parts.select("seed_id", "tile", "kind", "id")).select("seed_id", "tile", "kind", F.array_join("ids", ",").alias("ids"), "n_parts")


def tiled_objects(t):
    """The manifest's objects as seed and tile alone, which takes their boxes and no heights."""
    boxes = lambda v: v.groupBy("seed_id", "id").agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("z") + F.max("z")) / 2).alias("z"))
    buildings = T.world_tile(boxes(t.rings())).select("seed_id", F.explode(F.array("tile", "tile")).alias("tile"))  # one and its roof
    roads = T.world_tile(boxes(t.road_points())).select("seed_id", "tile")
    return buildings.unionByName(roads).unionByName(t.seeds.select("seed_id", F.lit(None).cast("string").alias("tile")))


def stats(t):
    nodes, edges = entry_graph(t)
    return W.world_stats(t.seeds, t.resolved(), t["road_base"], nodes, edges, tiled_objects(t), E.grid_summary(t.grid()))


@query("d4_world_stats", with_("rv", "road_base", "grid", "rr", "bbox", more=BUILT + ", " + BOBJ) + f"""SELECT s.seed_id, b.n AS buildings, b.p AS provided_heights, b.l AS level_heights, b.i AS inferred_heights, b.shaped AS shaped_roofs, o.n AS semantic_objects, o.tiles, coalesce(r.n, 0) AS roads, coalesce(n.n, 0) AS road_nodes, coalesce(e.n, 0) AS road_edges, coalesce(e.m, 0) AS drivable_meters, {rd('sm.high - sm.low')} AS relief
FROM seeds s JOIN (SELECT seed_id, count(*) AS n, count(*) FILTER (WHERE quality = 'provided') AS p, count(*) FILTER (WHERE quality = 'levels') AS l, count(*) FILTER (WHERE quality = 'inferred') AS i, count(*) FILTER (WHERE profile <> 'flat') AS shaped FROM rr GROUP BY seed_id) b ON b.seed_id = s.seed_id
JOIN (SELECT seed_id, count(*) AS n, count(DISTINCT tile) AS tiles FROM ot GROUP BY seed_id) o ON o.seed_id = s.seed_id LEFT JOIN (SELECT seed_id, count(*) AS n FROM road_base GROUP BY seed_id) r ON r.seed_id = s.seed_id LEFT JOIN (SELECT seed_id, count(*) AS n FROM nodes GROUP BY seed_id) n ON n.seed_id = s.seed_id
LEFT JOIN (SELECT seed_id, count(*) AS n, CAST(floor(sum(length) + 0.5e0) AS BIGINT) AS m FROM edges GROUP BY seed_id) e ON e.seed_id = s.seed_id JOIN sm ON sm.seed_id = s.seed_id""")
def _(t):
    return rounded(stats(t), "relief")


@query("d6_height_quality_grade", with_("rr") + f"SELECT seed_id, {rd('known')} AS known, CASE WHEN seed_id % 5 = 0 THEN 'DEMO' WHEN seed_id % 5 = 1 THEN 'PLATEAU LOD2' WHEN seed_id % 5 = 2 THEN 'PLATEAU LOD1' WHEN known > 0.65 THEN 'STRONG' WHEN known > 0.25 THEN 'MIXED' ELSE 'INFERRED' END AS grade FROM (SELECT seed_id, count(*) FILTER (WHERE quality <> 'inferred') / CAST(count(*) AS DOUBLE) AS known FROM rr GROUP BY seed_id)")
def _(t):
    q = lambda k: F.count_if(F.col("height_quality") == k)
    s = t.resolved().groupBy("seed_id").agg(F.count(F.lit(1)).alias("buildings"), q("provided").alias("provided_heights"), q("levels").alias("level_heights"))
    s = s.withColumns({"is_demo": F.col("seed_id") % 5 == 0, "lod2": (F.col("seed_id") % 5 == 1).cast("int"), "lod1": (F.col("seed_id") % 5 == 2).cast("int")})
    return W.quality_grade(s).select("seed_id", r("known"), "grade")


def _providers(t):
    primary = t["buildings"].where("seed_id % 4 <> 0").select("seed_id", "id", F.lit("first").alias("provider"))
    fallback = t["supplier"].select(F.col("s_nationkey").alias("seed_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("second").alias("provider"))
    return primary, fallback


@query("u1_prefer_source", with_("buildings") + "SELECT seed_id, id, 'first' AS provider FROM buildings WHERE seed_id % 4 <> 0 UNION ALL SELECT s_nationkey, concat('s', CAST(s_suppkey AS VARCHAR)), 'second' FROM supplier WHERE s_nationkey NOT IN (SELECT seed_id FROM buildings WHERE seed_id % 4 <> 0)")
def _(t):
    return W.prefer_source(*_providers(t))


@query("u1_source_warnings", with_("buildings") + "SELECT s.seed_id, concat_ws('; ', CASE WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = s.seed_id) THEN 'streets and land data missing' END, CASE WHEN s.seed_id % 4 = 0 THEN 'fallback buildings' END, CASE WHEN s.seed_id % 3 = 0 THEN 'fallback roads' END, CASE WHEN s.seed_id % 2 = 0 THEN 'flat terrain' END) AS warnings FROM seeds s")
def _(t):
    primary, fallback = _providers(t)
    c = W.source_choices(t.seeds, primary, t["road_base"].where("seed_id % 3 <> 0"), fallback, t.grid().where("seed_id % 2 <> 0"))
    return W.require_data(c).select("seed_id", "warnings")


@query("g15_world_dataset", with_("buildings") + "SELECT seed_id, count(*) AS n, coalesce(string_agg(DISTINCT geometry_source, ',' ORDER BY geometry_source) FILTER (WHERE geometry_source <> ''), '') AS sources FROM (SELECT seed_id, geometry_source FROM buildings WHERE seed_id % 4 <> 0 UNION ALL SELECT s_nationkey, 'fallback' FROM supplier WHERE s_nationkey % 4 = 0) GROUP BY seed_id")
def _(t):
    _, fallback = _providers(t)
    primary = t["buildings"].where("seed_id % 4 <> 0").select("seed_id", "id", "geometry_source")
    world = W.prefer_source(primary, fallback.select("seed_id", "id", F.lit("fallback").alias("geometry_source")))
    n = world.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(W.source_details(world), "seed_id").select("seed_id", "n", F.array_join("sources", ",").alias("sources"))


def _surfaces(t):
    """Surfaces of detailed buildings: five vertices each, some repeated, some ground."""
    v = t["building_vertices"].groupBy("id", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    rows = v.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    elevation = F.when(F.col("k") == 3, F.lit(0.0)).otherwise(F.col("k") * 5.0) + F.when(F.col("k") == 2, F.lit(0.0)).otherwise(0.0)
    kind = F.when((F.col("k") % 3 == 0) & (F.col("ord") % 2 == 0), "ground").when(F.col("k") == 2, "roof").otherwise("wall")
    return rows.select(F.col("id").alias("building"), "ord", F.col("k").alias("ordinal"), kind.alias("kind"), F.transform("p", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"), elevation.alias("elevation"))).alias("vertices"))


@query("u3_dedupe_surfaces", with_("buildings") + "SELECT id AS building, CAST(k AS INTEGER) AS ordinal, CASE WHEN k % 3 = 0 AND ord % 2 = 0 THEN 'ground' WHEN k = 2 THEN 'roof' ELSE 'wall' END AS kind FROM buildings, range(3) r(k)")
def _(t):
    return I.dedupe_surfaces(_surfaces(t)).select("building", "ordinal", "kind")


@query("e31_select_footprint_surfaces", with_("buildings") + "SELECT id AS building, CAST(k AS INTEGER) AS ordinal FROM buildings, range(4) r(k) WHERE k IN (0, 3)")
def _(t):
    return I.footprint_surfaces(_surfaces(t)).select("building", "ordinal")


@query("g14_citygml_buildings", with_("buildings") + "SELECT id AS building, CAST(1 + ord % 2 AS INTEGER) AS lod, 3 AS n_surfaces, 1 AS n_footprints, 10e0 AS height, CASE WHEN ord % 2 = 1 THEN 'lod2' ELSE 'flat' END AS roof_shape FROM buildings")
def _(t):
    s = _surfaces(t).groupBy("building", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "vertices"))), lambda x: F.struct(x["kind"].alias("kind"), x["vertices"].alias("vertices"))).alias("surfaces"))
    b, _ = I.citygml_buildings(s.select(F.col("building").alias("id"), F.lit("n").alias("name"), (F.col("ord") % 2 + 1).cast("int").alias("lod"), "surfaces"))
    return b.select("building", "lod", F.col("n_surfaces").cast("int").alias("n_surfaces"), F.col("n_footprints").cast("int").alias("n_footprints"), "height", "roof_shape")


@query("d12_citygml_summary", with_("buildings") + "SELECT 0e0 AS base_elevation, count(*) FILTER (WHERE ord % 2 = 0) AS lod1, count(*) FILTER (WHERE ord % 2 = 1) AS lod2, 0 AS skipped FROM buildings")
def _(t):
    s = _surfaces(t).groupBy("building", "ord").agg(F.collect_list(F.struct("kind", "vertices")).alias("surfaces")).select(F.col("building").alias("id"), F.lit("n").alias("name"), (F.col("ord") % 2 + 1).cast("int").alias("lod"), "surfaces")
    b, _ = I.citygml_buildings(s)
    return I.citygml_summary(s, b).withColumn("skipped", F.col("skipped").cast("int"))


@query("d15_extent_and_radius", with_("bv", more="c AS (SELECT seed_id, (min(x) + max(x)) / 2 AS cx, (min(z) + max(z)) / 2 AS cz FROM bv GROUP BY seed_id)") + f"SELECT b.seed_id AS file, {rd('cx', 3)} AS cx, {rd('cz', 3)} AS cz, greatest(100e0, least(1000e0, ceil(max(sqrt(pow(x - cx, 2) + pow(z - cz, 2))) / 50) * 50)) AS radius FROM bv b JOIN c ON c.seed_id = b.seed_id GROUP BY b.seed_id, cx, cz")
def _(t):
    return I.extent_and_radius(t.rings().withColumnRenamed("seed_id", "file")).select("file", r("cx", 3), r("cz", 3), "radius")


@query("a13_world_metadata", with_("seeds") + "SELECT seed_id, radius, CAST(NULL AS DOUBLE) AS origin_lon, CAST(NULL AS DOUBLE) AS origin_lat, false AS exact_origin_included FROM seeds UNION ALL SELECT seed_id + 100, radius, lon, lat, true FROM seeds")
def _(t):
    plain = W.world_metadata(t.seeds)
    full = W.world_metadata(t.seeds, True).withColumn("seed_id", F.col("seed_id") + 100)
    return plain.unionByName(full)


@query("a14_privacy_safe_export", with_("seeds") + "SELECT seed_id, radius, false AS exact_origin_included FROM seeds")
def _(t):
    return W.privacy_safe(t.seeds)


@query("a15_attribution_document", with_("buildings") + "SELECT s.seed_id, concat(CASE WHEN s.seed_id % 3 = 0 THEN '- Synthetic demonstration data.' ELSE '- Streets - ODbL' || chr(10) || '- Terrain - CC' END, CASE WHEN s.seed_id IN (SELECT seed_id FROM buildings WHERE geometry_source = 'overture') THEN chr(10) || 'Geometry source details: overture.' ELSE '' END) AS document FROM seeds s")
def _(t):
    rows = F.array(F.struct(F.lit(1).alias("rank"), F.lit("Streets").alias("label"), F.lit("ODbL").alias("license")), F.struct(F.lit(2).alias("rank"), F.lit("Terrain").alias("label"), F.lit("CC").alias("license")))
    a = t.seeds.where("seed_id % 3 <> 0").select("seed_id", F.explode(rows).alias("row")).select("seed_id", "row.*")
    return W.attribution_document(a, t.seeds.join(W.source_details(t["buildings"]), "seed_id", "left"))


#: What telemetry() asks of an edge.
ROAD = ("kind", "width", "name")


def on_roads(positions, edges):
    """Positions of vehicles with the road that they are on; it comes with the match."""
    near = S.nearest_road(positions, edges, "event_id", more=ROAD).select("seed_id", "event_id", "distance", *ROAD)
    return M.telemetry(positions.join(near, ["seed_id", "event_id"], "left")).select("event_id", "speed_kph", "road_name", "off_road")


@query("s1_telemetry_enrich", built(f"SELECT t.event_id, CAST(floor(abs(t.speed) * 3.6e0 + 0.5e0) AS INTEGER) AS speed_kph, coalesce(name, replace(kind, '_', ' '), 'No drivable road') AS road_name, coalesce(dist > width * 0.62e0 + 1.4e0, true) AS off_road FROM telemetry t LEFT JOIN (SELECT * FROM ({NEAREST}) WHERE k = 1) n ON n.event_id = t.event_id", "telemetry", more=EPN))
def _(t):
    return on_roads(t["telemetry"], placed_edges(t, *ROAD))


def drive_route():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in ((0.0, 0.0), (5.0, 5.0), (-5.0, 5.0))])


@query("s2_challenge_progress", with_("telemetry", more="""o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, x / 50 AS x, z / 50 AS z, abs(speed) > 1.2 AS moves, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM telemetry),
f AS (SELECT user_id, event_id, sec, n, CASE WHEN moves THEN CASE WHEN sqrt(pow(x - 5, 2) + pow(z - 5, 2)) <= 9 THEN 2 ELSE 1 END ELSE 1 END AS nxt, moves AS started, 0e0 AS elapsed FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.sec, o.n, CASE WHEN f.nxt < 3 AND (f.started OR o.moves) AND sqrt(pow(o.x - CASE f.nxt WHEN 1 THEN 5 ELSE -5 END, 2) + pow(o.z - 5, 2)) <= 9 THEN f.nxt + 1 ELSE f.nxt END, f.started OR o.moves,
CASE WHEN f.nxt < 3 AND (f.started OR o.moves) THEN f.elapsed + (o.sec - f.sec) ELSE f.elapsed END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT user_id, event_id, CASE WHEN nxt > 2 THEN 'finished' WHEN started THEN 'running' ELSE 'ready' END AS status, {rd('elapsed', 3)} AS elapsed, CAST(least(nxt, 2) AS INTEGER) AS checkpoint FROM f")
def _(t):
    e = t["telemetry"].select("user_id", "event_id", "ts", (F.col("x") / 50).alias("x"), (F.col("z") / 50).alias("z"), "speed")
    return rounded(M.challenge_batch(e, e.select("user_id").distinct().withColumn("route", drive_route())), "elapsed", digits=3)


@query("s3_best_time_stream", "SELECT event_type AS route, min(value) AS best_seconds FROM events GROUP BY event_type")
def _(t):
    return M.best_times(t["events"].select(F.col("event_type").alias("route"), F.col("value").alias("seconds")))


@query("t5_best_times", "SELECT user_id AS route, min(value) AS best_seconds FROM events GROUP BY user_id")
def _(t):
    return M.best_times(t["events"].select(F.col("user_id").alias("route"), F.col("value").alias("seconds")))


@query("s4_request_cooldown", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
f AS (SELECT user_id, event_id, ms AS last, n, true AS accepted FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, CASE WHEN o.ms - f.last >= 43200000 THEN o.ms ELSE f.last END, o.n, o.ms - f.last >= 43200000 FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, event_id, accepted FROM f""")
def _(t):
    return M.cooldown_batch(t["events"].select("user_id", "event_id", "ts"), 43_200_000)


@query("s5_active_tiles", with_("telemetry") + "SELECT user_id, event_id, tile AS signature FROM (SELECT *, lag(tile) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, concat(CAST(CAST(floor((x + 150) / 300) AS INTEGER) AS VARCHAR), ':', CAST(CAST(floor((z + 150) / 300) AS INTEGER) AS VARCHAR)) AS tile FROM telemetry)) WHERE before IS NULL OR before <> tile")
def _(t):
    return M.signature_changes(T.world_tile(t["telemetry"]).select("user_id", "event_id", "ts", "tile")).select("user_id", "event_id", "signature")


@query("w7_signature_changes", with_("telemetry", more="k AS (SELECT *, CASE WHEN x > z THEN 'a' END AS one, CASE WHEN x > 0 THEN 'b' END AS two FROM telemetry), s AS (SELECT user_id, event_id, ts, concat_ws('|', one, two, 'c') AS signature FROM k)") + "SELECT user_id, event_id, signature FROM (SELECT *, lag(signature) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) WHERE before IS NULL OR before <> signature")
def _(t):
    tiles = F.array_compact(F.array(F.lit("c"), F.when(F.col("x") > F.col("z"), "a"), F.when(F.col("x") > 0, "b"), F.lit("c")))
    return M.signature_changes(t["telemetry"].select("user_id", "event_id", "ts", F.explode(tiles).alias("tile"))).select("user_id", "event_id", "signature")


@query("s6_telemetry_sampling", with_("telemetry", more="k AS (SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS slot FROM telemetry)") + "SELECT user_id, slot, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM k GROUP BY user_id, slot")
def _(t):
    return M.sample_telemetry(t["telemetry"], "1 hour").select("user_id", "slot", "event_id", "n")


@query("w9_ewma", with_("telemetry", more="o AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9 AS t, speed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM telemetry)").replace("WITH ", "WITH RECURSIVE ", 1) + f", f AS (SELECT user_id, event_id, t, n, speed AS cur FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.t, o.n, f.cur + (o.speed - f.cur) * (1 - exp(-greatest(0e0, o.t - f.t) * 0.2e0)) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1) SELECT event_id, {rd('cur')} AS smooth FROM f")
def _(t):
    s = t["telemetry"].select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), F.col("speed").alias("value"))
    return M.ewma(s, 0.2).select("event_id", r("smooth"))


TTL_MS = 7 * 86_400_000


@query("s7_cache_ttl", f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
f AS (SELECT user_id, event_id, ms AS last, n, true AS accepted FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, CASE WHEN o.ms - f.last >= {TTL_MS} THEN o.ms ELSE f.last END, o.n, o.ms - f.last >= {TTL_MS} FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, event_id FROM f WHERE accepted""")
def _(t):
    return M.cooldown_batch(t["events"].select("user_id", "event_id", "ts"), TTL_MS).where("accepted").select("user_id", "event_id")


@query("w8_budget_prefix", with_("road_base", more="c AS (SELECT *, sum(width) OVER (PARTITION BY seed_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM road_base)") + "SELECT seed_id, id FROM c WHERE coalesce(before, 0) < 600")
def _(t):
    return X.budget_prefix(t["road_base"], 600.0, "width", "ord").select("seed_id", "id")
