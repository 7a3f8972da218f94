"""Column functions on literal values."""

import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, parse, resolve
from geoloom.sources.files import position_list


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_projection_round_trip(spark):
    lon0, lat0 = lit(139.767125, 35.681236)
    lon, lat = geo.lon_of(F.lit(237.4), lon0, lat0), geo.lat_of(F.lit(-91.7), lat0)
    x, z = one(spark, geo.local_x(lon, lon0, lat0), geo.local_z(lat, lat0))
    assert x == pytest.approx(237.4, abs=1e-6) and z == pytest.approx(-91.7, abs=1e-6)


def test_coordinates(spark):
    texts = ["35.681236, 139.767125", "95, 139", "https://maps.example/place/@48.85837,2.294481,17z", "https://maps.example/?q=48.85837%2C2.294481", "nothing", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse.coordinate_input(F.col("t")).alias("c"))
    got = {r["i"]: (tuple(r["c"]) if r["c"] else None) for r in df.collect()}
    assert got == {0: (139.767125, 35.681236), 1: None, 2: (2.294481, 48.85837), 3: (2.294481, 48.85837), 4: None, 5: None}


def test_lengths_speeds_colours(spark):
    row = one(spark, parse.length_metres(F.lit("12.5 m")), parse.length_metres(F.lit("30 ft")), parse.length_metres(F.lit(None).cast("string")), parse.osm_speed(F.lit("30 mph")), parse.osm_oneway(F.lit("-1")), parse.color(F.lit("Gray")), parse.color(F.lit("teal")), parse.osm_road_width(F.lit(None).cast("string"), F.lit("2"), F.lit("residential")))
    assert row[0] == 12.5 and row[1] == pytest.approx(9.144) and row[2] is None and row[3] == pytest.approx(48.28032)
    assert row[4] == "backward" and row[5] == "#8f9599" and row[6] is None and row[7] == pytest.approx(6.3)


def test_rules(spark):
    back, ahead = ('[{"access_type":"denied","when":{"heading":"%s"}}]' % w for w in ("backward", "forward"))
    row = one(spark, parse.connectors(F.lit('[{"connector_id":"a","at":0},{"connector_id":"b","at":0.75}]')), parse.oneway_rules(F.lit(back)), parse.oneway_rules(F.lit(ahead)), parse.speed_rules(F.lit('[{"max_speed":{"value":50,"unit":"km/h"}}]')), parse.connectors(F.lit("oops")), parse.speed_rules(F.lit(None).cast("string")))
    assert [tuple(c) for c in row[0]] == [("a", 0.0), ("b", 0.75)] and row[1] == "forward" and row[2] == "backward" and row[3] == 50 and row[4] == [] and row[5] is None


def test_heights(spark):
    h = lambda height, levels, kind: resolve.building_height(F.lit("office-1"), F.lit(height).cast("double"), F.lit(None).cast("double"), F.lit(levels).cast("double"), F.lit(kind))
    a, b, c, d = one(spark, h(22, 3, "x").alias("a"), h(None, 5, "x").alias("b"), h(None, None, "office").alias("c"), h(None, None, "office").alias("d"))
    assert (a["height"], a["quality"]) == (22, "provided") and (b["height"], b["quality"]) == (16, "levels") and c == d and c["quality"] == "inferred"


def test_fnv(spark):
    assert one(spark, geo.fnv1a(F.lit("office-1")))[0] == 2792605759


def test_roofs(spark):
    r = lambda s, given, total: resolve.roof(F.lit(s).cast("string"), F.lit(given).cast("double"), F.lit(float(total)))
    rows = one(spark, *[c.alias(f"c{i}") for i, c in enumerate((r("half_hipped", None, 20), r("pyramidal", 99, 10), r("shed", None, 20), r(None, None, 20), r("gabled", 4.5, 20)))])
    assert [x["profile"] for x in rows] == ["gabled", "hipped", "skillion", "flat", "gabled"]
    assert rows[0]["height"] == pytest.approx(3.2) and rows[1]["height"] < 4 and rows[3]["height"] == 0 and rows[4]["height"] == 4.5


def test_clip_and_terrain_values(spark):
    c = geo.clip_to_circle(*lit(-20.0, 0.0, 20.0, 0.0, 10.0))
    t0, t1, a, b = one(spark, c["t0"], c["t1"], resolve.terrarium(*lit(137, 219, 68)), resolve.terrarium(*lit(128, 0, 0)))
    assert (-20 + 40 * t0, -20 + 40 * t1, a, b) == (-10, 10, 2523.265625, 0)
    sizes = one(spark, *[resolve.grid_size(F.lit(float(r))).alias(f"r{r}") for r in (100, 300, 301, 600, 601, 1000)])
    assert list(sizes) == [65, 65, 129, 129, 257, 257]


def test_mesh_profile(spark):
    p = one(spark, resolve.mesh_profile(F.lit(7.8125), F.lit(1000.0)).alias("p"))["p"]
    assert p["sectors"] == 384 and 100 <= p["rings"] <= 128


def test_position_list(spark):
    row = one(spark, position_list(F.lit("35.6 139.7 12 35.61 139.71 13"), 3).alias("a"), position_list(F.lit(""), 3).alias("b"))
    assert [tuple(v) for v in row["a"]] == [(139.7, 35.6, 12.0), (139.71, 35.61, 13.0)] and row["b"] == []


def test_urls(spark):
    row = one(spark, parse.app_url(F.lit("https://a.example/x?lat=35#y")), parse.has_seed(F.lit("https://a.example/?lat=35")), parse.has_seed(F.lit("https://a.example/?latitude=35")), parse.share_url(F.lit("https://a.example/?q=1"), F.lit(2.5), F.lit(1.25), F.lit(549.6), F.lit("day"), F.lit("walk")))
    assert list(row) == ["https://a.example/x", True, False, "https://a.example/?lat=1.250000&lng=2.500000&r=550&style=day&mode=walk"]


def test_streaming_range(spark):
    row = one(spark, *[resolve.streaming_range(F.lit(m), F.lit(500.0)).alias(m) for m in ("orbit", "fly", "walk")])
    assert (row["orbit"]["base"], row["fly"]["base"], row["walk"]["base"]) == (1125.0, 720.0, 480.0)


def test_wrapped(spark):
    from geoloom.operators.network import wrapped

    got = one(spark, *[wrapped(F.lit(a)).alias(str(i)) for i, a in enumerate((0.0, 4.0, -4.0, 7.0))])
    assert list(got) == pytest.approx([0.0, 4 - 2 * math.pi, 2 * math.pi - 4, 7 - 2 * math.pi])
