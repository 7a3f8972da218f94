"""Results kept for a week under a key of provider, place and radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up

TTL_DAYS = 7


def cache_key(provider: str, lon: Column, lat: Column, radius: Column) -> Column:
    return F.concat(F.lit(f"{provider}:"), F.format_string("%.5f:%.5f:", lon, lat), half_up(radius).cast("long").cast("string"))


def load_missing(requests: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests (key, ...), each once: a cached row counts while its expires_at is not before now; of several
    of a key the one that expires last counts, of those the greatest value."""
    live = cache.where(F.col("expires_at") >= now).groupBy("key").agg(F.max(F.struct("expires_at", "value"))["value"].alias("value"))
    return requests.join(live, "key"), requests.join(live.select("key"), "key", "left_anti")


def purge(cache: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number removed) when the rows of a key prefix go."""
    ours = F.col("key").startswith(prefix)
    return cache.where(~ours), cache.agg(F.count_if(ours).alias("removed"))
