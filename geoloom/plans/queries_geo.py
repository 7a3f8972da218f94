"""Queries of seeds, tiles, projections, attributes and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, parse, resolve
from ..operators import buildings as B
from ..operators import osm as O
from ..operators import spatial as S
from ..operators import tiling as T
from ..operators import world as W
from ..sources import cache as C
from ..sources import demo as D
from .registry import DEG, RAD, fnv, hav, query, r, rd, rounded, tx, ty, unit, with_

BOX = f"(radius / {RAD} / {DEG})", f"(radius / ({RAD} * cos(lat * {DEG})) / {DEG})"


@query("b2_bounds_around", with_("seeds") + f"SELECT seed_id, {rd('lon - ' + BOX[1], 7)} AS west, {rd('lat - ' + BOX[0], 7)} AS south, {rd('lon + ' + BOX[1], 7)} AS east, {rd('lat + ' + BOX[0], 7)} AS north FROM seeds")
def _(t):
    return rounded(T.bounds_around(t.seeds).select("seed_id", "west", "south", "east", "north"), "west", "south", "east", "north", digits=7)


@query("b1_tiles_for_bounds", with_("seeds") + f"""SELECT seed_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, 14 AS z FROM (SELECT seed_id, unnest(range({tx('lon - ' + BOX[1])}, {tx('lon + ' + BOX[1])} + 1)) AS x, {ty('lat + ' + BOX[0])} AS y0, {ty('lat - ' + BOX[0])} AS y1 FROM seeds), range(16384) k(y) WHERE y BETWEEN y0 AND y1""")
def _(t):
    return T.tiles_for_bounds(T.bounds_around(t.seeds)).select("seed_id", "x", "y", "z")


@query("b3_to_local_meters", with_("bv") + f"SELECT seed_id, id, pos, {rd('x')} AS x, {rd('z')} AS z FROM bv")
def _(t):
    return rounded(t.rings(), "x", "z")


@query("b4_from_local_meters", with_("telemetry") + f"SELECT event_id, t.seed_id, {rd(f'lon + x / ({RAD} * cos(lat * {DEG})) / {DEG}', 8)} AS lon, {rd(f'lat - z / {RAD} / {DEG}', 8)} AS lat FROM telemetry t JOIN seeds s ON s.seed_id = t.seed_id")
def _(t):
    return rounded(T.from_local(t["telemetry"].select("event_id", "seed_id", "x", "z"), t.seeds).select("event_id", "seed_id", "lon", "lat"), "lon", "lat", digits=8)


@query("b5_haversine_meters", with_("buildings") + f"SELECT b.seed_id, id, {rd(hav('s.lon', 's.lat', 'clon', 'clat'))} AS distance FROM buildings b JOIN seeds s ON s.seed_id = b.seed_id")
def _(t):
    p = t["buildings"].select("seed_id", "id", F.col("clon").alias("lon"), F.col("clat").alias("lat"))
    return rounded(T.seed_distance(p, t.seeds).select("seed_id", "id", "distance"), "distance")


@query("b6_world_tile", with_("telemetry") + "SELECT event_id, CAST(floor((x + 150) / 300) AS INTEGER) AS tile_x, CAST(floor((z + 150) / 300) AS INTEGER) AS tile_z, concat(CAST(CAST(floor((x + 150) / 300) AS INTEGER) AS VARCHAR), ':', CAST(CAST(floor((z + 150) / 300) AS INTEGER) AS VARCHAR)) AS tile, floor((x + 150) / 300) * 300e0 AS center_x, floor((z + 150) / 300) * 300e0 AS center_z FROM telemetry")
def _(t):
    return T.world_tile(t["telemetry"]).select("event_id", "tile_x", "tile_z", "tile", "center_x", "center_z")


OSM_LAYER = "CASE WHEN building IS NOT NULL THEN 'building' WHEN \"natural\" = 'water' OR leisure = 'park' OR landuse IN ('forest', 'grass', 'meadow', 'recreation_ground', 'village_green') OR (highway = 'pedestrian' AND area = 'yes') THEN 'area' WHEN railway IS NOT NULL OR waterway IS NOT NULL OR highway IS NOT NULL THEN 'road' END"
OSM_ROAD = "CASE WHEN railway IS NOT NULL THEN concat('railway:', railway) WHEN waterway IS NOT NULL THEN 'waterway' ELSE highway END"
OSM_AREA = "CASE WHEN \"natural\" = 'water' THEN 'water' WHEN leisure = 'park' THEN 'park' WHEN landuse = 'forest' THEN 'forest' WHEN landuse IN ('grass', 'meadow', 'recreation_ground', 'village_green') THEN 'park' WHEN highway = 'pedestrian' AND area = 'yes' THEN 'pedestrian' END"


@query("b7_classify_osm", with_("osm") + f"SELECT id, layer, CASE layer WHEN 'building' THEN building WHEN 'area' THEN {OSM_AREA} WHEN 'road' THEN {OSM_ROAD} END AS kind FROM (SELECT *, {OSM_LAYER} AS layer FROM osm)")
def _(t):
    return O.classify(t["osm"]).select("id", "layer", "kind")


@query("b8_osm_road_kind", with_("osm") + f"SELECT id, {OSM_ROAD} AS kind FROM osm")
def _(t):
    return t["osm"].select("id", O.road_kind(t["osm"]).alias("kind"))


@query("b9_drivable_roads", with_("road_base") + "SELECT id, seed_id, kind FROM road_base WHERE kind <> 'footway'")
def _(t):
    from ..operators.roads import drivable

    return drivable(t["road_base"]).select("id", "seed_id", "kind")


@query("b10_osm_polygons", with_("osm") + "SELECT id, CASE WHEN n_points < 3 THEN 0 WHEN id % 3 = 0 THEN 2 ELSE 1 END AS n_polygons, CASE WHEN n_points >= 3 THEN n_points + 1 END AS n_vertices FROM osm")
def _(t):
    o = t["osm"]
    ring = F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= F.col("n_points")), lambda i: F.struct((F.col("id") % 50 + i * i).cast("double").alias("lat"), (F.col("id") % 90 - i).cast("double").alias("lon")))
    member = lambda role: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), F.col("id").alias("ref"), ring.alias("geometry"))
    el = o.select("id", F.when(F.col("id") % 3 == 0, "relation").otherwise("way").alias("type"), ring.alias("geometry"), F.array(member("outer"), member("inner"), member("")).alias("members"))
    return O.polygons(el).select("id", F.size("polygons").alias("n_polygons"), F.size(F.get(F.get("polygons", 0), 0)).alias("n"), "polygons").select("id", "n_polygons", F.when(F.col("n_polygons") > 0, F.col("n")).alias("n_vertices"))


@query("b11_clean_rings", with_("bv") + "SELECT seed_id, id, CASE WHEN abs(a) > 0.05 THEN 4 ELSE 0 END AS n FROM (SELECT seed_id, id, sum(x * nz - nx * z) / 2 AS a FROM (SELECT *, lead(x) OVER w AS nx, lead(z) OVER w AS nz FROM bv WINDOW w AS (PARTITION BY seed_id, id ORDER BY pos)) WHERE nx IS NOT NULL GROUP BY seed_id, id)")
def _(t):
    return B.clean_rings(B.rings(t.rings())).select("seed_id", "id", F.size("ring").alias("n"))


@query("b12_touches_radius", with_("building_vertices") + f"SELECT DISTINCT v.seed_id, id FROM building_vertices v JOIN seeds s ON s.seed_id = v.seed_id WHERE {hav('s.lon', 's.lat', 'v.lon', 'v.lat')} <= radius + 80")
def _(t):
    from .views import paths

    return T.touches_radius(paths(t["building_vertices"], "seed_id", "id"), t.seeds, 80.0).select("seed_id", "id")


@query("b14_clamp_radius", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 500e0 ELSE greatest(100e0, least(1000e0, c_acctbal)) END AS radius FROM customer")
def _(t):
    return T.clamp_radius(t["customer"].select("c_custkey", F.col("c_acctbal").alias("radius")))


@query("c1_features_within_radius", with_("buildings") + f"SELECT s.seed_id, id, {rd(hav('s.lon', 's.lat', 'clon', 'clat'))} AS distance FROM buildings CROSS JOIN seeds s WHERE {hav('s.lon', 's.lat', 'clon', 'clat')} <= s.radius + 80")
def _(t):
    p = t["buildings"].select("id", F.col("clon").alias("lon"), F.col("clat").alias("lat"))
    return rounded(T.features_within_radius(p, t.seeds, 80.0).select("seed_id", "id", "distance"), "distance")


PIP = "sum(CASE WHEN (az > p.z) <> (bz > p.z) AND p.x < (bx - ax) * (p.z - az) / CASE WHEN bz <> az THEN bz - az END + ax THEN 1 ELSE 0 END) % 2 = 1"


@query("c3_point_in_polygon_join", with_("bseg", "telemetry") + f"SELECT p.seed_id, p.event_id AS point, b.id FROM telemetry p JOIN bseg b ON b.seed_id = p.seed_id GROUP BY p.seed_id, p.event_id, p.x, p.z, b.id HAVING {PIP}")
def _(t):
    return S.point_in_polygon(t.positions(), t.rings())


DIST = "sqrt(pow(p.x - (ax + (bx - ax) * t), 2) + pow(p.z - (az + (bz - az) * t), 2))"


def _blocked(pad: float) -> str:
    from .registry import proj

    return f"SELECT seed_id, event_id FROM (SELECT p.*, b.id, ax, az, bx, bz, {proj('p.x', 'p.z', 'ax', 'az', 'bx', 'bz')} AS t FROM telemetry p JOIN bseg b ON b.seed_id = p.seed_id) p GROUP BY seed_id, event_id, x, z, id HAVING {PIP} OR min({DIST}) < {pad}"


@query("c4_can_occupy", with_("bseg", "telemetry", more=f"bad AS ({_blocked(1.1)})") + "SELECT p.seed_id, p.event_id AS point FROM telemetry p JOIN seeds s ON s.seed_id = p.seed_id WHERE sqrt(x * x + z * z) <= radius - 1.1 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.seed_id = p.seed_id AND bad.event_id = p.event_id)")
def _(t):
    return S.can_occupy(t.positions().select("seed_id", "point", "x", "z"), t.rings(), t.seeds).select("seed_id", "point")


@query("c5_polygon_measures", with_("bv") + f"SELECT seed_id, id, {rd('sum(x * nz - nx * z) / 2', 3)} AS area, {rd('avg(x)')} AS mean_x, {rd('avg(z)')} AS mean_z FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(z) OVER w, first_value(z) OVER w) AS nz FROM bv WINDOW w AS (PARTITION BY seed_id, id ORDER BY pos)) GROUP BY seed_id, id")
def _(t):
    return B.polygon_measures(B.rings(t.rings())).select("seed_id", "id", r("area", 3), r("mean_x"), r("mean_z"))


@query("c11_enrich_detailed_buildings", with_("buildings") + "SELECT b.id, b.kind, CAST(1 + s_suppkey % 2 AS INTEGER) AS lod, s_acctbal AS n_surfaces FROM buildings b LEFT JOIN supplier ON concat('b', CAST(s_suppkey AS VARCHAR)) = b.id")
def _(t):
    detailed = t["supplier"].select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("lod"), F.col("s_acctbal").alias("n_surfaces"))
    return B.enrich_detailed(t["buildings"].select("id", "kind"), detailed)


REACH = {"walk": "least(900e0, greatest(480e0, radius * 0.78e0))", "fly": "least(1350e0, greatest(720e0, radius * 1.15e0))", "orbit": "greatest(600e0, radius * 2.25e0)"}


def _visible(mode: str) -> str:
    return f"SELECT p.seed_id, event_id, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_z AS INTEGER) AS tile_z FROM telemetry p JOIN seeds s ON s.seed_id = p.seed_id JOIN (SELECT DISTINCT seed_id, floor((x + 150) / 300) AS tile_x, floor((z + 150) / 300) AS tile_z FROM telemetry) k ON k.seed_id = p.seed_id WHERE sqrt(pow(tile_x * 300 - x, 2) + pow(tile_z * 300 - z, 2)) <= {REACH[mode]} + 212.13203435596427e0"


for _mode in REACH:
    @query(f"c12_visible_tiles_{_mode}", with_("telemetry") + _visible(_mode))
    def _(t, mode=_mode):
        at = t["telemetry"].join(t.seeds.select("seed_id", "radius"), "seed_id")
        return T.visible_tiles(at, T.world_tile(t["telemetry"]), mode)


@query("c14_open_spawn", with_("bseg", more=f"""cand AS (SELECT seed_id, radius, k AS event_id, CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN 16e0 WHEN 3 THEN -16e0 WHEN 4 THEN 0e0 ELSE cos(((k - 5) % 12) * pi() / 6) * (24 + ((k - 5) // 12) * 18) END AS x,
CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 16e0 WHEN 2 THEN 0e0 WHEN 3 THEN 0e0 WHEN 4 THEN -16e0 ELSE sin(((k - 5) % 12) * pi() / 6) * (24 + ((k - 5) // 12) * 18) END AS z FROM seeds, range(800) r(k) WHERE k < 5 OR 24 + ((k - 5) // 12) * 18 < radius * 0.7e0),
bad AS ({_blocked(2.0).replace('telemetry p', 'cand p')}), free AS (SELECT * FROM cand c WHERE sqrt(x * x + z * z) <= radius - 2 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.seed_id = c.seed_id AND bad.event_id = c.event_id)), best AS (SELECT seed_id, arg_min(x, event_id) AS x, arg_min(z, event_id) AS z FROM free GROUP BY seed_id)""") + f"SELECT s.seed_id, {rd('coalesce(x, 0)')} AS x, {rd('coalesce(z, 0)')} AS z FROM seeds s LEFT JOIN best b ON b.seed_id = s.seed_id")
def _(t):
    return rounded(S.open_spawn(t.seeds, t.rings()), "x", "z")


@query("d1_merge_tile_fragments", with_("building_vertices", "buildings", more="""frag AS (SELECT b.id, b.ord * 4 + k AS ord, CASE k WHEN 0 THEN kind ELSE 'late' END AS kind, height, CASE WHEN k = 1 THEN concat('half;', b.id) ELSE concat('whole;', b.id) END AS signature FROM buildings b, range(3) r(k)),
shapes AS (SELECT id, signature, min(ord) AS ord FROM frag GROUP BY id, signature)""") + "SELECT f.id, arg_min(kind, ord) AS kind, arg_min(coalesce(height, -1e0), ord) AS height, count(*) AS n_fragments, (SELECT string_agg(signature, '|' ORDER BY ord) FROM shapes s WHERE s.id = f.id) AS signatures FROM frag f GROUP BY f.id")
def _(t):
    b = t["buildings"]
    frag = b.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("id", (F.col("ord") * 4 + F.col("k")).alias("ord"), F.when(F.col("k") == 0, F.col("kind")).otherwise("late").alias("kind"), "height", F.concat(F.when(F.col("k") == 1, "half;").otherwise("whole;"), "id").alias("signature"))
    return B.merge_tile_fragments(frag).select("id", "kind", F.coalesce("height", F.lit(-1.0)).alias("height"), "n_fragments", F.array_join("signatures", "|").alias("signatures"))


@query("d11_source_details", with_("buildings") + "SELECT seed_id, coalesce(string_agg(DISTINCT geometry_source, ',' ORDER BY geometry_source) FILTER (WHERE geometry_source <> ''), '') AS sources FROM buildings GROUP BY seed_id")
def _(t):
    return W.source_details(t["buildings"]).select("seed_id", F.array_join("sources", ",").alias("sources"))


@query("t1_nearest_buildings", with_("rb", "bbox", "bv", more="m AS (SELECT seed_id, id, avg(x) AS mx, avg(z) AS mz FROM bv GROUP BY seed_id, id), s AS (SELECT rb.seed_id, rb.id, rb.ord, sqrt(mx * mx + mz * mz) - 0.2e0 * least(rh, 100e0) AS score FROM rb JOIN m ON m.seed_id = rb.seed_id AND m.id = rb.id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY round(score, 6), ord) AS INTEGER) AS rank, count(*) OVER (PARTITION BY seed_id) AS n FROM s)") + f"SELECT seed_id, id, rank, {rd('score', 3)} AS score, greatest(n - 2500, 0) AS truncated FROM k WHERE rank <= 2500")
def _(t):
    means = B.polygon_measures(B.rings(t.rings())).select("seed_id", "id", "mean_x", "mean_z")
    return B.nearest_buildings(B.resolve_heights(t["buildings"]), means).select("seed_id", "id", "rank", r("score", 3), "truncated")


@query("j1_extract_coordinates", with_("urls") + r"""SELECT page_id, coalesce(t_lon, u_lon) AS lon, coalesce(t_lat, u_lat) AS lat FROM (
SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN abs(page_id % 120 - 20 + CASE WHEN page_id % 120 - 20 < 0 THEN -0.5e0 ELSE 0.5e0 END) <= 90 THEN CAST(page_id % 200 - 100 AS DOUBLE) END END AS t_lon,
CASE page_id % 3 WHEN 0 THEN CASE WHEN abs(page_id % 120 - 20 + CASE WHEN page_id % 120 - 20 < 0 THEN -0.5e0 ELSE 0.5e0 END) <= 90 THEN page_id % 120 - 20 + CASE WHEN page_id % 120 - 20 < 0 THEN -0.5e0 ELSE 0.5e0 END END END AS t_lat,
CASE page_id % 4 WHEN 1 THEN page_id % 180 + 0.25e0 WHEN 2 THEN CASE WHEN page_id % 120 <= 90 THEN page_id % 180 + 0.75e0 END END AS u_lon, CASE page_id % 4 WHEN 1 THEN page_id % 90 + 0.5e0 WHEN 2 THEN CASE WHEN page_id % 120 <= 90 THEN CAST(page_id % 120 AS DOUBLE) END END AS u_lat FROM urls)""")
def _(t):
    c = F.coalesce(parse.coordinate_input(F.col("text")), parse.coordinate_input(F.col("url")))
    return t["urls"].select("page_id", c["lon"].alias("lon"), c["lat"].alias("lat"))


@query("j8_scrub_urls", with_("urls") + r"""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS app_url, (page_id % 4 = 0 AND strpos(url, '&lat=') < strpos(url, '#')) AS has_seed, concat(regexp_replace(url, '[?#].*$', ''), printf('?lat=%.6f&lng=%.6f&r=', page_id % 90 + 0.5e0, CAST(page_id % 180 AS DOUBLE)), CAST(CAST(floor(page_id % 7 * 100 + 49.6e0 + 0.5e0) AS BIGINT) AS VARCHAR), '&style=day&mode=walk') AS share_url FROM urls""")
def _(t):
    share = parse.share_url(F.col("url"), (F.col("page_id") % 180).cast("double"), F.col("page_id") % 90 + F.lit(0.5), F.col("page_id") % 7 * 100 + F.lit(49.6), F.lit("day"), F.lit("walk"))
    return t["urls"].select("page_id", parse.app_url(F.col("url")).alias("app_url"), parse.has_seed(F.col("url")).alias("has_seed"), share.alias("share_url"))


OSM_W = "CASE id % 6 WHEN 0 THEN 12.5e0 WHEN 1 THEN 9.144e0 WHEN 4 THEN CAST(width AS DOUBLE) END"
OSM_WIDTH = f"coalesce(greatest(1e0, least(32e0, CASE WHEN {OSM_W} > 0 THEN {OSM_W} END)), greatest(2.5e0, least(28e0, CASE lanes WHEN '2' THEN 6.3e0 WHEN '14' THEN 44.1e0 END)), CASE WHEN kind LIKE 'railway:%' THEN 2.2e0 WHEN kind = 'waterway' THEN 3e0 WHEN kind = 'primary' THEN 9e0 WHEN kind = 'pedestrian' THEN 4e0 WHEN kind = 'footway' THEN 1.8e0 ELSE 4.5e0 END)"
# greatest and least skip nulls, so absent widths are guarded
OSM_WIDTH = f"CASE WHEN {OSM_W} > 0 THEN greatest(1e0, least(32e0, {OSM_W})) WHEN lanes = '2' THEN 6.3e0 WHEN lanes = '14' THEN 28e0 WHEN kind LIKE 'railway:%' THEN 2.2e0 WHEN kind = 'waterway' THEN 3e0 WHEN kind = 'primary' THEN 9e0 WHEN kind = 'pedestrian' THEN 4e0 WHEN kind = 'footway' THEN 1.8e0 ELSE 4.5e0 END"


@query("j2_normalize_osm", with_("osm", more=f"c AS (SELECT *, {OSM_LAYER} AS layer FROM osm), k AS (SELECT *, CASE layer WHEN 'building' THEN building WHEN 'area' THEN {OSM_AREA} ELSE {OSM_ROAD} END AS kind FROM c)") + f"""SELECT id, layer, kind, CASE WHEN layer = 'road' THEN {rd(OSM_WIDTH)} END AS width, CASE WHEN layer = 'road' THEN CASE maxspeed WHEN '30 mph' THEN {rd('48.28032e0')} WHEN '50' THEN 50e0 END END AS speed_limit,
CASE WHEN layer = 'road' THEN CASE oneway WHEN 'Yes' THEN 'forward' WHEN '1' THEN 'forward' WHEN '-1' THEN 'backward' ELSE 'both' END END AS one_way, CASE WHEN layer = 'building' THEN CASE colour WHEN 'Grey' THEN '#8f9599' WHEN '#A1b2C3' THEN colour END END AS color
FROM k WHERE (layer IN ('building', 'area') AND n_points >= 3) OR (layer = 'road' AND n_points >= 2)""")
def _(t):
    b, roads, areas = O.normalize(t["osm"])
    none = lambda kind: F.lit(None).cast(kind)
    return (
        b.select("id", "layer", "kind", none("double").alias("width"), none("double").alias("speed_limit"), none("string").alias("one_way"), F.col("facade_color").alias("color"))
        .unionByName(roads.select("id", "layer", "kind", (F.round("road_width", 4) + 0.0).alias("width"), (F.round("speed_limit", 4) + 0.0).alias("speed_limit"), "one_way", none("string").alias("color")))
        .unionByName(areas.select("id", "layer", "kind", none("double").alias("width"), none("double").alias("speed_limit"), none("string").alias("one_way"), none("string").alias("color")))
    )


@query("j3_normalize_transportation", """SELECT p_partkey AS id, k AS kind, CASE p_partkey % 4 WHEN 0 THEN 32e0 WHEN 1 THEN 2.4e0 ELSE CASE k WHEN 'motorway' THEN 13e0 WHEN 'track' THEN 3.5e0 WHEN 'path' THEN 1.5e0 WHEN 'residential' THEN 5.8e0 ELSE 4.5e0 END END AS width,
CASE p_partkey % 5 WHEN 0 THEN 'c1@0.25,c2@1.0' WHEN 1 THEN 'c3@0.0' ELSE '' END AS connectors, CASE p_partkey % 4 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' ELSE 'both' END AS one_way,
CASE p_partkey % 3 WHEN 0 THEN 48.28032e0 WHEN 1 THEN 70e0 ELSE CASE k WHEN 'motorway' THEN 100e0 WHEN 'track' THEN 15e0 ELSE 30e0 END END AS speed_limit, CASE WHEN k IN ('track', 'path') THEN 'unpaved' ELSE 'paved' END AS surface
FROM (SELECT *, CASE p_partkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'track' WHEN 2 THEN 'path' WHEN 3 THEN 'residential' ELSE 'plaza' END AS k FROM part)""")
def _(t):
    key = F.col("p_partkey")
    case = lambda m, *v: parse.lookup(dict(enumerate(v)), (key % m).cast("int"))
    seg = t["part"].select(
        key.alias("id"), F.coalesce(case(7, "motorway", "track", "path", "residential"), F.lit("plaza")).alias("kind"), case(4, "40", "1.5", "-3", "wide").alias("width"),
        case(5, '[{"connector_id":"c1","at":0.25},7,{"connector_id":"c2","at":"3"}]', '[{"connector_id":"c3","at":-1},{"at":0.5}]', "[oops", "").alias("connectors"),
        case(4, '[{"access_type":"denied","when":{"heading":"backward"}}]', '[{"access_type":"denied","when":{"heading":"forward"}}]', '[{"access_type":"denied","when":{"heading":"forward"}},{"access_type":"denied","when":{"heading":"backward"}}]').alias("access_restrictions"),
        case(3, '[{"max_speed":{"value":30,"unit":"mph"}}]', '[{"max_speed":{"value":0,"unit":"km/h"}},{"max_speed":{"value":70,"unit":"km/h"}}]').alias("speed_limits"),
    )
    out = O.normalize_transportation(seg)
    return out.withColumn("connectors", F.array_join(F.transform("connectors", lambda c: F.concat(c["id"], F.lit("@"), c["at"].cast("string"))), ","))


@query("j4_resolve_heights", with_("rb") + f"SELECT seed_id, id, {rd('rh')} AS resolved_height, {rd('rmin')} AS resolved_min_height, quality AS height_quality FROM rb")
def _(t):
    return B.resolve_heights(t["buildings"]).select("seed_id", "id", r("resolved_height"), r("resolved_min_height"), "height_quality")


@query("j5_resolve_roofs", with_("rr") + f"SELECT seed_id, id, profile AS roof_profile, {rd('rise')} AS roof_rise, rsource AS roof_source FROM rr")
def _(t):
    return t.resolved().select("seed_id", "id", "roof_profile", r("roof_rise"), "roof_source")


@query("j9_assign_hash_bucket", with_("buildings") + f"SELECT id, {rd(unit('id'), 9)} AS unit, CAST(floor({unit(chr(39).join(['concat(id, ', ':roof', ')']))} * 6) % 6 AS INTEGER) AS bucket FROM buildings")
def _(t):
    return t["buildings"].select("id", (F.round(geo.seeded_unit(F.col("id")), 9) + 0.0).alias("unit"), (F.floor(geo.seeded_unit(F.concat("id", F.lit(":roof"))) * 6) % 6).cast("int").alias("bucket"))


@query("e21_terrain_profile", with_("seeds") + "SELECT seed_id, CASE WHEN radius <= 300 THEN 65 WHEN radius <= 600 THEN 129 ELSE 257 END AS grid_size, CAST(least(128, greatest(32, ceil(radius / greatest(6e0, 1.15e0 * res)))) AS INTEGER) AS rings, CAST(least(384, greatest(128, ceil(ceil(2 * pi() * radius / greatest(10e0, 1.7e0 * res)) / 32) * 32)) AS INTEGER) AS sectors FROM (SELECT *, greatest(2e0, 2 * radius / (CASE WHEN radius <= 300 THEN 64e0 WHEN radius <= 600 THEN 128e0 ELSE 256e0 END)) AS res FROM seeds)")
def _(t):
    n = resolve.grid_size(F.col("radius"))
    p = resolve.mesh_profile(F.col("radius") * 2 / (n - 1), F.col("radius"))
    return t.seeds.select("seed_id", n.alias("grid_size"), p["rings"].alias("rings"), p["sectors"].alias("sectors"))


@query("e20_terrarium_decode", "SELECT p_partkey, (p_partkey % 256) * 256 + (p_size % 256) + (p_partkey * 7 % 256) / 256e0 - 32768 AS elevation FROM part")
def _(t):
    return t["part"].select("p_partkey", resolve.terrarium(F.col("p_partkey") % 256, F.col("p_size") % 256, F.col("p_partkey") * 7 % 256).alias("elevation"))


@query("e23_streaming_range", with_("seeds") + "SELECT seed_id, greatest(600e0, radius * 2.25e0) AS orbit_base, least(900e0, greatest(480e0, radius * 0.8e0)) AS fly_detail, least(620e0, greatest(340e0, radius * 0.55e0)) AS walk_detail FROM seeds")
def _(t):
    at = lambda mode: resolve.streaming_range(F.lit(mode), F.col("radius"))
    return t.seeds.select("seed_id", at("orbit")["base"].alias("orbit_base"), at("fly")["detail"].alias("fly_detail"), at("walk")["detail"].alias("walk_detail"))


@query("e27_route_seed", with_("seeds") + f"SELECT seed_id, {fnv("concat(printf('%.5f:%.5f:', lon, lat), CAST(CAST(radius AS BIGINT) AS VARCHAR))")} AS route_seed FROM seeds")
def _(t):
    from ..operators.network import route_seed

    return route_seed(t.seeds)


@query("e28_compact_properties", with_("buildings") + "SELECT id, 1 + CASE WHEN height IS NULL THEN 0 ELSE 1 END + CASE WHEN levels IS NULL THEN 0 ELSE 1 END AS n FROM buildings")
def _(t):
    p = F.create_map(F.lit("kind"), F.col("kind"), F.lit("height"), F.col("height").cast("string"), F.lit("levels"), F.col("levels").cast("string"))
    return W.compact_properties(t["buildings"].select("id", p.alias("properties"))).select("id", F.size("properties").alias("n"))


@query("e30_parse_position_list", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS n, CASE c_custkey % 4 WHEN 0 THEN 139.5e0 WHEN 1 THEN 120e0 WHEN 2 THEN 0e0 END AS lon FROM customer")
def _(t):
    from ..sources.files import position_list

    texts = parse.lookup({0: "35.5 139.5 12 35.6 139.6 13", 1: "120 35 7 100 200 8", 2: "1 0 5 2 1 5 3 2 5 1 0 5", 3: ""}, (F.col("c_custkey") % 4).cast("int"))
    v = position_list(texts, 3)
    return t["customer"].select("c_custkey", F.size(v).alias("n"), F.get(v, 0)["lon"].alias("lon"))


@query("a6_demo_city", with_("seeds", more=f"""k AS (SELECT seed_id, radius, -radius + 45e0 + i * 54e0 AS gx, -radius + 45e0 + j * 54e0 AS gz, i, j FROM seeds, range(40) a(i), range(40) b(j) WHERE -radius + 45e0 + i * 54e0 < radius - 45e0 AND -radius + 45e0 + j * 54e0 < radius - 45e0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY i, j) AS INTEGER) AS n FROM k WHERE sqrt(gx * gx + gz * gz) <= radius - 38 AND abs(gx) >= 13 AND abs(gz) >= 13 AND NOT (gx > 50 AND gx < 180 AND gz > -180 AND gz < -50)),
d AS (SELECT *, concat('demo-building-', CAST(n - 1 AS VARCHAR)) AS id FROM n)""") + f"""SELECT seed_id, id, {rd('gx + (' + unit("concat(id, ':x')") + ' - 0.5e0) * 9')} AS x, {rd('20 + ' + unit("concat(id, ':w')") + ' * 18')} AS width, CASE WHEN n % 5 = 0 THEN {rd('18 + ' + unit("concat(id, ':h')") + ' * 54')} END AS height,
CASE WHEN n % 3 = 0 THEN 3 + floor({unit("concat(id, ':l')")} * 8) END AS levels, CASE WHEN n % 4 = 0 THEN 'commercial' ELSE 'residential' END AS kind, CASE WHEN n % 7 = 0 THEN 'gabled' WHEN n % 11 = 0 THEN 'hipped' ELSE 'flat' END AS roof_shape, CASE WHEN n % 5 = 0 THEN '#8d5f56' END AS roof_color FROM d""")
def _(t):
    return D.demo_buildings(t.seeds).select("seed_id", "id", r("x"), r("width"), r("height"), "levels", "kind", "roof_shape", "roof_color")


@query("a6_demo_areas", with_("seeds") + "SELECT seed_id, 'demo-park' AS id, 'park' AS kind, 60e0 AS x, -170e0 AS z, 160e0 AS width, 120e0 AS depth FROM seeds UNION ALL SELECT seed_id, 'demo-water', 'water', 35e0 - radius, 0e0, 42e0, radius * 1.6e0 FROM seeds")
def _(t):
    return D.demo_areas(t.seeds)


@query("a6_demo_roads", with_("seeds", more="g AS (SELECT seed_id, radius, floor((k * 54 - radius) * 100 + 0.5e0) / 100 AS o FROM seeds, range(40) r(k) WHERE k * 54 <= 2 * radius), f AS (SELECT * FROM g UNION ALL SELECT seed_id, radius, radius FROM g GROUP BY seed_id, radius HAVING max(o) < radius), c AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY abs(o), o) AS near, CAST(count(*) OVER (PARTITION BY seed_id) AS INTEGER) AS n_points FROM f)") + "SELECT seed_id, axis, o AS \"offset\", n_points, CASE WHEN near = 1 THEN 'primary' ELSE 'residential' END AS kind, CASE WHEN near = 1 THEN 12e0 ELSE 6e0 END AS width, CASE WHEN near = 1 THEN 50e0 ELSE 30e0 END AS speed_limit FROM c CROSS JOIN (VALUES ('x'), ('z')) a(axis)")
def _(t):
    return D.demo_roads(t.seeds)


_KEY = "concat('buildings:', printf('%.5f:%.5f:', clon, clat), CAST(CAST(floor(radius + 0.5e0) AS BIGINT) AS VARCHAR))"


def _requests(t):
    b = t["buildings"].join(t.seeds.select("seed_id", "radius"), "seed_id")
    req = b.select("id", "ord", C.cache_key("buildings", F.col("clon"), F.col("clat"), F.col("radius")).alias("key"))
    cached = req.where("ord % 3 <> 1").select("key", F.col("ord").alias("value"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ord") % 7 * 86400).alias("expires_at"))
    return req, cached


@query("a8_load_missing", with_("buildings", more=f"q AS (SELECT id, ord, {_KEY} AS key FROM buildings JOIN seeds USING (seed_id)), c AS (SELECT key, ord AS value, row_number() OVER (PARTITION BY key ORDER BY ord % 7 DESC, ord DESC) AS k FROM q WHERE ord % 3 <> 1 AND ord % 7 >= 3)") + "SELECT q.id, c.value FROM q LEFT JOIN c ON c.key = q.key AND c.k = 1")
def _(t):
    req, cached = _requests(t)
    hits, misses = C.load_missing(req, cached, F.timestamp_seconds(F.lit(1_700_000_000 + 3 * 86400)))
    return hits.select("id", "value").unionByName(misses.select("id", F.lit(None).cast("long").alias("value")))


@query("a9_purge_cache", with_("buildings") + "SELECT count(*) AS n_left, (SELECT count(*) FROM buildings WHERE ord % 3 <> 1 AND ord % 2 = 0) AS removed FROM buildings WHERE ord % 3 <> 1 AND ord % 2 <> 0")
def _(t):
    _, cached = _requests(t)
    mixed = cached.withColumn("key", F.when(F.col("value") % 2 == 0, F.col("key")).otherwise(F.concat(F.lit("other:"), "key")))
    stay, removed = C.purge(mixed, "buildings:")
    return stay.agg(F.count(F.lit(1)).alias("n_left")).join(F.broadcast(removed))


@query("flagship_height_quality", with_("rb", more=f"""near AS (SELECT s.seed_id, b.id, b.quality, b.rh FROM rb b CROSS JOIN seeds s WHERE {hav('s.lon', 's.lat', 'clon', 'clat')} <= s.radius)""") + f"""SELECT s.seed_id, coalesce(n, 0) AS buildings, coalesce(known, 0e0) AS known, CASE WHEN known > 0.65 THEN 'STRONG' WHEN known > 0.25 THEN 'MIXED' ELSE 'INFERRED' END AS grade, mean_height FROM seeds s LEFT JOIN (SELECT seed_id, count(*) AS n, {rd("count(*) FILTER (WHERE quality <> 'inferred') / CAST(count(*) AS DOUBLE)")} AS known, {rd('avg(rh)')} AS mean_height FROM near GROUP BY seed_id) k ON k.seed_id = s.seed_id""")
def flagship(t):
    """For every seed: the buildings within its radius, how tall they are, and the grade of what is known of their heights."""
    resolved = B.resolve_heights(t["buildings"])
    points = resolved.select("id", F.col("clon").alias("lon"), F.col("clat").alias("lat"), "resolved_height", "height_quality")
    near = T.features_within_radius(points, t.seeds)
    q = lambda k: F.count_if(F.col("height_quality") == k)
    stats = near.groupBy("seed_id").agg(F.count(F.lit(1)).alias("buildings"), q("provided").alias("provided_heights"), q("levels").alias("level_heights"), F.avg("resolved_height").alias("mean_height"))
    every = t.seeds.select("seed_id").join(stats, "seed_id", "left").fillna(0, ["buildings", "provided_heights", "level_heights"])
    return W.quality_grade(every).select("seed_id", "buildings", r("known"), "grade", r("mean_height"))
