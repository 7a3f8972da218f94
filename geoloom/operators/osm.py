"""Tagged elements: routing to one layer each, and normalisation to typed tables. `tags` may be a map column or plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse

# Land uses shown as parks.
PARK_LANDUSE = ("grass", "meadow", "recreation_ground", "village_green")


def tag(df: DataFrame, name: str) -> Column:
    """A tag's value, from the map `tags` or from a column of its name."""
    return F.col("tags")[name] if "tags" in df.columns else F.col(name) if name in df.columns else F.lit(None).cast("string")


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def area_kind(df: DataFrame) -> Column:
    t = lambda n: tag(df, n)
    return F.when(t("natural") == "water", "water").when(t("leisure") == "park", "park").when(t("landuse") == "forest", "forest").when(t("landuse").isin(*PARK_LANDUSE), "park").when((t("highway") == "pedestrian") & (t("area") == "yes"), "pedestrian")


def road_kind(df: DataFrame) -> Column:
    t = lambda n: tag(df, n)
    return F.when(_given(t("railway")), F.concat(F.lit("railway:"), t("railway"))).when(_given(t("waterway")), F.lit("waterway")).when(_given(t("highway")), t("highway"))


def classify(elements: DataFrame) -> DataFrame:
    """elements with layer and kind: buildings first, then areas, then roads; a building stays one whatever its geometry."""
    area, road, building = area_kind(elements), road_kind(elements), tag(elements, "building")
    layer = F.when(_given(building), "building").when(area.isNotNull(), "area").when(road.isNotNull(), "road")
    use = F.coalesce(tag(elements, "building:use"), building) if "tags" in elements.columns else building
    return elements.withColumn("layer", layer).withColumn("kind", F.when(F.col("layer") == "building", use).when(F.col("layer") == "area", area).when(F.col("layer") == "road", road))


def road_attributes(roads: DataFrame) -> DataFrame:
    """Width, speed limit and one-way of classified roads."""
    t = lambda n: tag(roads, n)
    return roads.withColumns({"road_width": parse.osm_road_width(t("width"), t("lanes"), F.col("kind")), "speed_limit": parse.osm_speed(t("maxspeed")), "one_way": parse.osm_oneway(t("oneway"))})


def normalize(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(buildings, roads, areas) of elements (id, tags or tag columns, n_points): typed attributes of each layer.

    An area needs a ring of three points, a road two. The three are filters of one plan; cache it if all are written.
    """
    c = classify(elements)
    buildings = c.where("layer = 'building' and n_points >= 3").withColumn("facade_color", parse.color(tag(c, "colour")))
    areas = c.where("layer = 'area' and n_points >= 3")
    return buildings, road_attributes(c.where("layer = 'road' and n_points >= 2")), areas


def select_tagged(elements: DataFrame) -> DataFrame:
    """The elements that any layer can use."""
    t = lambda n: tag(elements, n)
    wanted = _given(t("building")) | _given(t("highway")) | _given(t("railway")) | _given(t("waterway")) | (t("natural") == "water") | (t("leisure") == "park") | t("landuse").isin("forest", *PARK_LANDUSE)
    return elements.where(F.coalesce(wanted, F.lit(False)))


def polygons(elements: DataFrame) -> DataFrame:
    """elements (type, geometry, members) with `polygons`: a way of at least three finite points, closed; of a relation each
    way that is not inner as a polygon of its own."""
    path = lambda g: F.filter(F.transform(F.coalesce(g, F.array().cast("array<struct<lat:double,lon:double>>")), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]))
    closed = lambda r: F.when(F.get(r, 0) == F.try_element_at(r, F.lit(-1)), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    own = path(F.col("geometry"))
    outer = F.filter(F.transform(F.filter(F.coalesce("members", F.array().cast(dict(elements.dtypes)["members"])), lambda m: (m["type"] == "way") & (F.coalesce(m["role"], F.lit("")) != "inner")), lambda m: path(m["geometry"])), lambda r: F.size(r) >= 3)
    none = F.array().cast("array<array<array<struct<lon:double,lat:double>>>>")
    return elements.withColumn("polygons", F.when(F.col("type") == "way", F.when(F.size(own) >= 3, F.array(F.array(closed(own)))).otherwise(none)).otherwise(F.transform(outer, lambda r: F.array(closed(r)))))


def normalize_transportation(segments: DataFrame) -> DataFrame:
    """Segments (id, kind, width, connectors, access_restrictions, speed_limits as JSON texts) as typed roads."""
    return segments.select("id", "kind", parse.segment_width(F.col("width"), F.col("kind")).alias("width"), parse.connectors(F.col("connectors")).alias("connectors"), parse.oneway_rules(F.col("access_restrictions")).alias("one_way"), F.coalesce(parse.speed_rules(F.col("speed_limits")), parse.segment_speed(F.col("kind"))).alias("speed_limit"), parse.segment_surface(F.col("kind")).alias("surface"))
