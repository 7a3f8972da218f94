"""Sources and sinks: tables are laid out in the shared folder as a provider or an export has them, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import osm as O
from ..operators import world as W
from ..operators.storage import durable, shared_dir
from ..sources import files as I
from .queries_roads import entry_graph
from .queries_world import objects
from .registry import DEG, ORACLES, RAD, hav, query, r, tx, ty, with_
from .views import paths


def folder(t) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/source-{uuid.uuid4().hex}"


def by_tile(df, path: str, lon, lat) -> str:
    """The rows partitioned by the tile of a place, as a provider lays them out."""
    tiled = df.withColumns({"tile_x": geo.tile_x(lon, geo.FEATURE_ZOOM), "tile_y": geo.tile_y(lat, geo.FEATURE_ZOOM)})
    tiled.repartition("tile_x", "tile_y").write.partitionBy("tile_x", "tile_y").parquet(path)
    return path


def in_tiles(lon: str, lat: str, pad: int) -> str:
    """The place stands in a tile of the box around seed s."""
    d_lat, d_lon = f"(s.radius + {pad}) / {RAD} / {DEG}", f"(s.radius + {pad}) / ({RAD} * cos(s.lat * {DEG})) / {DEG}"
    return f"{tx(lon)} BETWEEN {tx(f'(s.lon - {d_lon})')} AND {tx(f'(s.lon + {d_lon})')} AND {ty(lat)} BETWEEN {ty(f'(s.lat + {d_lat})')} AND {ty(f'(s.lat - {d_lat})')}"


@query("a1_read_buildings", with_("building_vertices", "buildings", more=f"near AS (SELECT DISTINCT s.seed_id, v.id FROM building_vertices v JOIN seeds s ON {hav('s.lon', 's.lat', 'v.lon', 'v.lat')} <= s.radius + 80)") + f"SELECT n.seed_id, b.id, b.kind, b.height, b.levels, 5 AS n_vertices FROM near n JOIN buildings b ON b.id = n.id JOIN seeds s ON s.seed_id = n.seed_id WHERE {in_tiles('b.clon', 'b.clat', 80)}")
def _(t):
    rings = paths(t["building_vertices"], "id").withColumnRenamed("path", "ring")
    rows = t["buildings"].drop("seed_id").join(rings, "id").select("id", F.lit("n").alias("name"), "height", "levels", "kind", "ring", F.col("ord").alias("ordinal"), "clon", "clat")
    found = I.read_buildings(t.spark, by_tile(rows, folder(t), F.col("clon"), F.col("clat")), t.seeds)
    return found.select("seed_id", "id", "kind", "height", "levels", F.size("ring").alias("n_vertices"))


@query("a2_read_transportation", with_("road_vertices", more=f"""v AS (SELECT *, first_value(lon) OVER w AS flon, first_value(lat) OVER w AS flat FROM road_vertices WHERE ord % 5 <> 0 WINDOW w AS (PARTITION BY id ORDER BY pos)),
near AS (SELECT DISTINCT s.seed_id, v.id FROM v JOIN seeds s ON {in_tiles('v.flon', 'v.flat', 180)} AND {hav('s.lon', 's.lat', 'v.lon', 'v.lat')} <= s.radius + 140)""") + f"SELECT seed_id, 'segment' AS part, id FROM near UNION ALL SELECT s.seed_id, 'connector', concat(v.id, ':', CAST(v.pos AS VARCHAR)) FROM road_vertices v JOIN seeds s ON {in_tiles('v.lon', 'v.lat', 260)} AND {hav('s.lon', 's.lat', 'v.lon', 'v.lat')} <= s.radius + 260 WHERE v.pos % 2 = 0")
def _(t):
    roads = paths(t["road_vertices"], "id", "ord").select("id", F.when(F.col("ord") % 5 == 0, "rail").otherwise("road").alias("subtype"), "path")
    first = F.get("path", 0)
    segments = by_tile(roads, folder(t), first["lon"], first["lat"])
    joints = t["road_vertices"].where("pos % 2 = 0").select(F.concat_ws(":", "id", "pos").alias("id"), "lon", "lat")
    found, connectors = I.read_transportation(t.spark, segments, by_tile(joints, folder(t), F.col("lon"), F.col("lat")), t.seeds)
    return found.select("seed_id", F.lit("segment").alias("part"), "id").unionByName(connectors.select("seed_id", F.lit("connector").alias("part"), "id"))


TAGS = ("building", "natural", "leisure", "landuse", "highway", "railway", "waterway", "area")


@query("a3_read_osm_elements", with_("osm") + """SELECT id, n_points, CASE WHEN building IS NOT NULL THEN 'building' END AS building, highway FROM osm
WHERE building <> '' OR highway <> '' OR railway <> '' OR waterway <> '' OR "natural" = 'water' OR leisure = 'park' OR landuse IN ('forest', 'grass', 'meadow', 'recreation_ground', 'village_green')""")
def _(t):
    path = folder(t)
    tags = F.map_filter(F.create_map(*[x for c in TAGS for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    geometry = F.when(F.col("n_points") > 0, F.transform(F.sequence(F.lit(1), F.col("n_points")), lambda i: F.struct((i * 0.5).alias("lat"), (i * 0.25).alias("lon"))))
    t["osm"].select(F.to_json(F.struct(F.lit("way").alias("type"), "id", tags.alias("tags"), geometry.alias("geometry")))).write.text(path)
    found = I.read_osm_elements(t.spark, path)
    return found.select("id", F.coalesce(F.size("geometry"), F.lit(0)).alias("n_points"), F.when(O.tag(found, "building").isNotNull(), "building").alias("building"), O.tag(found, "highway").alias("highway"))


def _xml(surfaces: F.Column) -> F.Column:
    """A building's text: surfaces with a kind at level of detail 2 where it is odd, else a plain solid."""
    numbers = lambda s: F.array_join(F.transform(s["vertices"], lambda v: F.concat_ws(" ", v["lat"].cast("string"), v["lon"].cast("string"), v["elevation"].cast("string"))), " ")
    ring = lambda s: F.concat(F.lit("<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), numbers(s), F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>"))
    themed = F.transform(surfaces, lambda s: F.concat(F.lit("<bldg:boundedBy><bldg:"), F.initcap(s["kind"]), F.lit("Surface><bldg:lod2MultiSurface><gml:MultiSurface>"), ring(s), F.lit("</gml:MultiSurface></bldg:lod2MultiSurface></bldg:"), F.initcap(s["kind"]), F.lit("Surface></bldg:boundedBy>")))
    plain = F.concat(F.lit("<bldg:lod1Solid><gml:Solid><gml:exterior><gml:CompositeSurface>"), F.array_join(F.transform(surfaces, ring), ""), F.lit("</gml:CompositeSurface></gml:exterior></gml:Solid></bldg:lod1Solid>"))
    body = F.when(F.col("ord") % 2 == 1, F.array_join(themed, "")).otherwise(plain)
    return F.concat(F.lit('<bldg:Building gml:id="'), F.col("id"), F.lit('"><gml:name>n</gml:name>'), body, F.lit("</bldg:Building>"))


@query("a5_read_citygml", with_("buildings") + "SELECT id AS building, CAST(1 + ord % 2 AS INTEGER) AS lod, 10e0 AS height, 2 AS n_surfaces, 1 AS n_footprints, CASE WHEN ord % 2 = 1 THEN 'ground,roof' ELSE 'other' END AS kinds FROM buildings")
def _(t):
    corners = t["building_vertices"].where("pos < 4").groupBy("id", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    at = lambda kind, height: F.struct(F.lit(kind).alias("kind"), F.transform("p", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"), F.lit(height).alias("elevation"))).alias("vertices"))
    path = folder(t)
    corners.withColumn("surfaces", F.array(at("ground", 5.0), at("roof", 15.0))).select(_xml(F.col("surfaces"))).write.text(path)
    built, surfaces = I.citygml_buildings(durable(I.read_citygml(t.spark, path, lines=True)))
    kinds = surfaces.groupBy("building").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return built.join(kinds, "building").select("building", "lod", "height", F.col("n_surfaces").cast("int").alias("n_surfaces"), F.col("n_footprints").cast("int").alias("n_footprints"), "kinds")


@query("a10_manifest_written", ORACLES["g5_manifest_objects"])
def _(t):
    path, made = folder(t), objects(t)
    W.write_manifest(made, path)
    return W.read_manifest(t.spark, path).select("seed_id", "object_id", "layer", "kind", r("min_x", 3), r("min_y", 3), r("max_z", 3), r("max_y", 3), r("center_x", 3), "tile")


@query("a11_road_graph_written", ORACLES["g1_road_graph_edges"])
def _(t):
    path = folder(t)
    W.write_road_graph(*entry_graph(t), path)
    return W.read_road_graph(t.spark, path)[1].select("seed_id", "edge", "from_node", "to_node", r("length", 3), "kind", "one_way")

