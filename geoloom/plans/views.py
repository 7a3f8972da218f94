"""Geometry derived from the given tables with exact arithmetic on integer keys; one SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tiling import small

#: name -> (tables or views that it reads, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "seeds": (("nation",), """
SELECT n_nationkey AS seed_id, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS lon, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat,
       CAST(100 + ((n_nationkey * 37) % 10) * 100 AS DOUBLE) AS radius FROM {nation}"""),
    "buildings": (("customer", "seeds"), """
SELECT s.seed_id, concat('b', CAST(c_custkey AS STRING)) AS id, c_custkey AS ord,
       s.lon + CAST((c_custkey * 7919) % 2001 - 1000 AS DOUBLE) / 111320e0 AS clon,
       s.lat - CAST((c_custkey * 104729) % 2001 - 1000 AS DOUBLE) / 111320e0 AS clat,
       CAST(8 + c_custkey % 33 AS DOUBLE) / 222640e0 AS hlon, CAST(8 + c_custkey % 29 AS DOUBLE) / 222640e0 AS hlat,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(1 + c_custkey % 400 AS DOUBLE) END AS height,
       CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 7 AS DOUBLE) END AS min_height,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS levels,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'apartments' WHEN 'AUTOMOBILE' THEN 'retail' WHEN 'MACHINERY' THEN 'industrial' WHEN 'HOUSEHOLD' THEN 'house' ELSE 'other' END AS kind,
       CASE WHEN c_custkey % 7 = 0 THEN 'Half_Hipped' WHEN c_custkey % 11 = 0 THEN 'pyramidal' WHEN c_custkey % 13 = 0 THEN 'shed' ELSE 'flat' END AS roof_shape,
       CASE WHEN c_custkey % 14 = 0 THEN CAST(c_custkey % 9 AS DOUBLE) END AS roof_height,
       CASE WHEN c_custkey % 2 = 0 THEN 'overture' WHEN c_custkey % 3 = 0 THEN '' END AS geometry_source
FROM {customer} JOIN {seeds} s ON s.seed_id = c_nationkey"""),
    "building_vertices": (("buildings",), """
SELECT seed_id, id, ord, pos, clon + sx * hlon AS lon, clat - sz * hlat AS lat
FROM {buildings} CROSS JOIN (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) AS k(pos, sx, sz)"""),
    "road_vertices": (("orders", "lineitem", "seeds"), """
SELECT s.seed_id, concat('r', CAST(o_orderkey AS STRING)) AS id, v.o_orderkey AS ord, v.pos,
       s.lon + CAST(v.x AS DOUBLE) / 111320e0 AS lon, s.lat - CAST(v.z AS DOUBLE) / 111320e0 AS lat, v.connector
FROM (SELECT o_orderkey, o_custkey % 25 AS seed_key, CAST(row_number() OVER w AS INT) - 1 AS pos, concat('c', CAST(l_suppkey AS STRING)) AS connector,
             (o_orderkey * 7919) % 1601 - 800 + sum((l_partkey * 31 + l_linenumber * 17) % 241 - 120) OVER w AS x,
             (o_orderkey * 104729) % 1601 - 800 + sum((l_partkey * 57 + l_suppkey * 7) % 241 - 120) OVER w AS z
      FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
      WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) v
JOIN {seeds} s ON s.seed_id = v.seed_key"""),
    "road_base": (("orders",), """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS id, o_orderkey AS ord, CAST(o_custkey % 25 AS INT) AS seed_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'residential' WHEN '4-NOT SPECIFIED' THEN 'footway' ELSE 'service' END AS kind,
       CASE o_orderstatus WHEN 'F' THEN 'forward' WHEN 'P' THEN 'backward' ELSE 'both' END AS one_way,
       CAST(3 + o_orderkey % 10 AS DOUBLE) AS width, CASE WHEN o_orderkey % 4 = 0 THEN concat('Road ', CAST(o_orderkey % 97 AS STRING)) END AS name
FROM {orders}"""),
    "telemetry": (("events",), """
SELECT event_id, user_id, ts, CAST(user_id % 25 AS INT) AS seed_id,
       CAST((event_id * 7919 + user_id * 31) % 1601 - 800 AS DOUBLE) AS x, CAST((event_id * 104729 + user_id * 17) % 1601 - 800 AS DOUBLE) AS z,
       CAST((event_id * 13) % 61 - 20 AS DOUBLE) AS speed, CAST((event_id * 29) % 628 AS DOUBLE) / 100e0 AS heading
FROM {events}"""),
    "urls": (("pages",), """
SELECT page_id, concat(url, CASE page_id % 4 WHEN 0 THEN concat('&lat=', CAST(page_id % 90 AS STRING), '&lng=', CAST(page_id % 180 AS STRING), '#x')
       WHEN 1 THEN concat('&q=', CAST(page_id % 90 AS STRING), '.5,', CAST(page_id % 180 AS STRING), '.25')
       WHEN 2 THEN concat('/@', CAST(page_id % 120 AS STRING), ',', CAST(page_id % 180 AS STRING), '.75,15z') ELSE '&latitude=1' END) AS url,
       CASE page_id % 3 WHEN 0 THEN concat('(', CAST(page_id % 120 - 20 AS STRING), '.5, ', CAST(page_id % 200 - 100 AS STRING), ')') WHEN 1 THEN concat(CAST(page_id % 90 AS STRING), ' 12 7') ELSE 'abc, 5' END AS text
FROM {pages}"""),
    "osm": (("part",), """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 7 = 0 THEN 'apartments' END AS building, CASE WHEN p_partkey % 5 = 0 THEN 'water' WHEN p_partkey % 5 = 1 THEN 'wood' END AS natural,
       CASE WHEN p_partkey % 6 = 0 THEN 'park' END AS leisure, CASE p_partkey % 8 WHEN 0 THEN 'forest' WHEN 1 THEN 'grass' WHEN 2 THEN 'meadow' WHEN 3 THEN 'retail' END AS landuse,
       CASE p_partkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'pedestrian' WHEN 2 THEN 'footway' END AS highway, CASE WHEN p_partkey % 9 = 0 THEN 'rail' END AS railway,
       CASE WHEN p_partkey % 11 = 0 THEN 'river' END AS waterway, CASE WHEN p_partkey % 10 = 1 THEN 'yes' END AS area, CAST(p_partkey % 5 AS INT) AS n_points,
       CASE p_partkey % 6 WHEN 0 THEN '12,5 m' WHEN 1 THEN '30 ft' WHEN 2 THEN '' WHEN 3 THEN '-4' WHEN 4 THEN concat(CAST(p_size AS STRING), '.5') END AS width,
       CASE p_partkey % 5 WHEN 0 THEN '2' WHEN 1 THEN 'x' WHEN 2 THEN '14' END AS lanes,
       CASE p_partkey % 5 WHEN 0 THEN '30 mph' WHEN 1 THEN '50' WHEN 2 THEN 'none' WHEN 3 THEN '0' END AS maxspeed,
       CASE p_partkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN '-1' WHEN 2 THEN '1' WHEN 3 THEN 'no' END AS oneway,
       CASE p_partkey % 5 WHEN 0 THEN 'Grey' WHEN 1 THEN '#A1b2C3' WHEN 2 THEN '#12' WHEN 3 THEN 'teal' END AS colour
FROM {part}"""),
}


def tables_of(name: str) -> list[str]:
    """The views that a view needs, in order, itself last."""
    found: list[str] = []
    for need in VIEWS[name][0]:
        if need in VIEWS:
            found += [n for n in tables_of(need) if n not in found]
    return [*found, name]


#: Rows of lineitem up to which a task takes them.
TASK_ROWS = 1 << 18


def spread(rows: DataFrame, column: str, most: int = TASK_ROWS) -> DataFrame:
    """rows (read from files) laid out by a column, in more partitions than the session's where a task would take over `most` rows."""
    n = -(-rows.count() // most)
    return rows.repartition(n, column) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(column)


def road_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of that name. Lines are laid out by road once: the window, the join with orders and what follows by road find
    them so, and what a task sorts doesn't grow with the table."""
    road = lambda key: F.concat(F.lit("r"), F.col(key).cast("string")).alias("id")
    lines = view(spark, sf_dir, "lineitem").select(road("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    w = Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = spread(lines, "id").select(
        "id", (F.row_number().over(w).cast("int") - 1).alias("pos"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("connector"),
        F.sum(F.expr("(l_partkey * 31 + l_linenumber * 17) % 241 - 120")).over(w).alias("dx"), F.sum(F.expr("(l_partkey * 57 + l_suppkey * 7) % 241 - 120")).over(w).alias("dz"),
    )
    orders = view(spark, sf_dir, "orders").select(road("o_orderkey"), F.col("o_orderkey").alias("ord"), F.expr("o_custkey % 25").alias("seed_key"))
    seeds = view(spark, sf_dir, "seeds").select("seed_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    met = moved.join(orders, "id").join(small(seeds), F.col("seed_id") == F.col("seed_key"))
    lon, lat = "lon0 + CAST((ord * 7919) % 1601 - 800 + dx AS DOUBLE) / 111320e0", "lat0 - CAST((ord * 104729) % 1601 - 800 + dz AS DOUBLE) / 111320e0"
    return met.select("seed_id", "id", "ord", "pos", F.expr(lon).alias("lon"), F.expr(lat).alias("lat"), "connector")


#: Views that Spark works out by other steps than their SQL, with the same rows.
LAID = {"road_vertices": road_vertices}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in LAID:
        return LAID[name](spark, sf_dir)
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """A WITH clause that defines views (and what they need) for the other engine."""
    order: list[str] = []
    for name in names:
        order += [n for n in tables_of(name) if n not in order]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].format(**{k: k for k in VIEWS[n][0]})})" for n in order)


def paths(vertices: DataFrame, *keys: str) -> DataFrame:
    """One row per feature with `path`, its vertices (lon, lat) in order."""
    made = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("path"))
    return made.withColumn("path", F.transform("path", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))))
