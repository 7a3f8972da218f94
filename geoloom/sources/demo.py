"""The synthetic city: buildings, roads and areas laid out around any seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import half_up, seeded_unit

SPACING, MARGIN = 54.0, 45.0


def demo_buildings(seeds: DataFrame) -> DataFrame:
    """Buildings on a lattice from MARGIN inside the square on, which leaves out the two main roads, the park and the rim:
    seed_id, id, n (from 1), x, z, width, depth, height, levels, kind, roof_shape, roof_height, roof_color."""
    last = F.ceil((F.col("radius") - MARGIN) * 2 / SPACING).cast("int") - 1
    at = lambda k: -F.col("radius") + MARGIN + F.col(k) * SPACING
    spread = seeds.select("seed_id", "radius").withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.explode(F.sequence(F.lit(0), last)))
    cells = spread.withColumns({"gx": at("i"), "gz": at("j")})
    cells = cells.where((F.sqrt(F.col("gx") ** 2 + F.col("gz") ** 2) <= F.col("radius") - 38) & (F.abs("gx") >= 13) & (F.abs("gz") >= 13))
    cells = cells.where("not (gx > 50 and gx < 180 and gz > -180 and gz < -50)")
    numbered = cells.withColumn("n", F.row_number().over(Window.partitionBy("seed_id").orderBy("i", "j")))
    b = numbered.withColumn("id", F.concat(F.lit("demo-building-"), (F.col("n") - 1).cast("string")))
    u = lambda s: seeded_unit(F.concat("id", F.lit(s)))
    every = lambda k: F.col("n") % k == 0
    return b.select(
        "seed_id", "id", "n", (F.col("gx") + (u(":x") - 0.5) * 9).alias("x"), (F.col("gz") + (u(":z") - 0.5) * 9).alias("z"), (u(":w") * 18 + 20).alias("width"), (u(":d") * 20 + 18).alias("depth"),
        F.when(every(5), u(":h") * 54 + 18).alias("height"), F.when(every(3), F.floor(u(":l") * 8) + 3).cast("double").alias("levels"), F.when(every(4), "commercial").otherwise("residential").alias("kind"),
        F.when(every(7), "gabled").when(every(11), "hipped").otherwise("flat").alias("roof_shape"), F.when(every(7), 3.5).alias("roof_height"), F.when(every(5), "#8d5f56").alias("roof_color"),
    )


def demo_roads(seeds: DataFrame) -> DataFrame:
    """Grid roads both ways: seed_id, id, axis, offset, kind, width, speed_limit, n_points."""
    steps = F.floor(F.col("radius") * 2 / SPACING).cast("int")
    grid = F.transform(F.sequence(F.lit(0), steps), lambda k: half_up((k * SPACING - F.col("radius")) * 100) / 100.0)
    full = F.when(F.try_element_at("grid", F.lit(-1)) < F.col("radius"), F.concat("grid", F.array("radius"))).otherwise(F.col("grid"))
    met = seeds.select("seed_id", "radius").withColumn("grid", grid).withColumn("grid", full)
    central = F.array_min(F.transform("grid", lambda o: F.struct(F.abs(o).alias("a"), F.array_position(F.col("grid"), o).alias("p"), o.alias("o"))))["o"]
    rows = met.withColumn("central", central).withColumn("n_points", F.size("grid")).select("seed_id", "central", "n_points", F.explode("grid").alias("offset"), F.array(F.lit("x"), F.lit("z")).alias("axes"))
    main = F.col("offset") == F.col("central")
    return rows.select("seed_id", F.explode("axes").alias("axis"), "offset", "n_points", F.when(main, "primary").otherwise("residential").alias("kind"), F.when(main, 12.0).otherwise(6.0).alias("width"), F.when(main, 50.0).otherwise(30.0).alias("speed_limit"))


def demo_areas(seeds: DataFrame) -> DataFrame:
    """One park and one stretch of water per seed, as centre and sides."""
    area = lambda id_, kind, x, z, w, d: F.struct(F.lit(id_).alias("id"), F.lit(kind).alias("kind"), x.alias("x"), z.alias("z"), w.alias("width"), d.alias("depth"))
    both = F.array(area("demo-park", "park", F.lit(60.0), F.lit(-170.0), F.lit(160.0), F.lit(120.0)), area("demo-water", "water", F.lit(35.0) - F.col("radius"), F.lit(0.0), F.lit(42.0), F.col("radius") * 1.6))
    return seeds.select("seed_id", F.explode(both).alias("a")).select("seed_id", "a.*")
