"""Column functions that settle missing attributes by priority: heights, roofs, terrain and streaming profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clamp, seeded_unit
from .parse import lookup

# Usual heights in metres.
HEIGHTS = {
    "apartments": 18.0, "commercial": 16.0, "office": 20.0, "retail": 10.0, "industrial": 9.0, "warehouse": 8.0, "house": 7.2,
    "residential": 10.0, "school": 11.0, "hospital": 17.0, "transportation": 13.0,
}
# Roof shapes by profile.
ROOFS = {"gabled": ["gabled", "gable", "saltbox", "half-hipped"], "hipped": ["hipped", "hip", "pyramidal", "pyramid", "dome", "onion", "cone"], "skillion": ["skillion", "shed", "lean-to"]}


def _positive(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def building_height(id_: Column, height: Column, min_height: Column, levels: Column, kind: Column) -> Column:
    """struct(height, min_height, quality): given, by levels, or inferred from the kind and a hash of the id."""
    given, floors = _positive(height), _positive(levels)
    low = F.coalesce(F.when((min_height >= 0) & ~F.isnan(min_height) & (min_height < float("inf")), min_height), F.lit(0.0))
    usual = F.coalesce(lookup(HEIGHTS, kind), F.lit(9.5)) * (0.78 + seeded_unit(id_) * 0.52)
    best = F.when(given.isNotNull(), clamp(given, 2.4, 360.0)).when(floors.isNotNull(), clamp(floors * 3.2, 3.2, 240.0)).otherwise(clamp(usual, 4.5, 60.0))
    return F.struct(
        best.alias("height"), F.when(given.isNotNull(), F.least(low, given - 1)).otherwise(low).alias("min_height"),
        F.when(given.isNotNull(), "provided").when(floors.isNotNull(), "levels").otherwise("inferred").alias("quality"),
    )


def roof_profile(shape: Column) -> Column:
    s = F.replace(F.lower(F.trim(shape)), F.lit("_"), F.lit("-"))
    return F.when(s.isin(ROOFS["gabled"]), "gabled").when(s.isin(ROOFS["hipped"]), "hipped").when(s.isin(ROOFS["skillion"]), "skillion").otherwise("flat")


def roof(shape: Column, supplied: Column, total: Column) -> Column:
    """struct(profile, height, source)."""
    p, given = roof_profile(shape), _positive(supplied)
    most = F.greatest(F.lit(0.8), F.least(F.lit(12.0), total * 0.38))
    ratio = lookup({"skillion": 0.1, "gabled": 0.16}, p, 0.19)
    h = F.when(p == "flat", 0.0).when(given.isNotNull(), F.least(most, F.greatest(F.lit(0.5), given))).otherwise(F.least(most, F.greatest(F.lit(1.2), total * ratio)))
    return F.struct(p.alias("profile"), h.alias("height"), F.when((p != "flat") & given.isNotNull(), "provided").otherwise("inferred").alias("source"))


def terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256.0 - 32768


def grid_size(radius: Column) -> Column:
    bounded = clamp(radius, 100.0, 1000.0)
    return F.when(bounded <= 300, 65).when(bounded <= 600, 129).otherwise(257)


def mesh_profile(resolution: Column, radius: Column) -> Column:
    """struct(sectors, rings, resolution) of the radial mesh."""
    res = F.greatest(F.lit(2.0), resolution)
    rings = clamp(F.ceil(radius / F.greatest(F.lit(6.0), res * 1.15)), 32, 128)
    raw = F.ceil(2 * math.pi * radius / F.greatest(F.lit(10.0), res * 1.7))
    return F.struct(clamp(F.ceil(raw / 32) * 32, 128, 384).cast("int").alias("sectors"), rings.cast("int").alias("rings"), res.alias("resolution"))


def streaming_range(mode: Column, radius: Column) -> Column:
    """struct(base, detail): how far tiles are kept in each mode."""
    high, fly = mode.isin("orbit", "drone"), mode == "fly"
    base = F.when(high, F.greatest(F.lit(600.0), radius * 2.25)).when(fly, clamp(radius * 1.15, 720.0, 1350.0)).otherwise(clamp(radius * 0.78, 480.0, 900.0))
    detail = F.when(high, F.greatest(F.lit(450.0), radius * 1.25)).when(fly, clamp(radius * 0.8, 480.0, 900.0)).otherwise(clamp(radius * 0.55, 340.0, 620.0))
    return F.struct(base.alias("base"), detail.alias("detail"))
