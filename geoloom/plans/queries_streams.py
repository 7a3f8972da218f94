"""The streams: each started over the files of a table, worked off and stopped; the rows of their batch twins' SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import tiling as T
from ..operators.storage import shared_dir
from ..streaming import run
from ..streaming import telemetry as M
from . import views
from .queries_roads import placed_edges
from .queries_world import ROAD, TTL_MS, drive_route, on_roads
from .registry import ORACLES, query, rounded


def place(t) -> str:
    """A new folder for a stream's rows and checkpoint."""
    return f"{shared_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(t, watermark: str | None = "1 minute"):
    return run.files(t.spark, f"{t.dir}/events.parquet", watermark)


def positions(t, watermark: str | None = "1 minute"):
    """The stream of events as positions of vehicles."""
    return t.spark.sql(views.VIEWS["telemetry"][1], events=events(t, watermark))


def as_(twin: str) -> str:
    return ORACLES[twin]


@query("s1_telemetry_stream", as_("s1_telemetry_enrich"))
def _(t):
    edges = placed_edges(t, *ROAD)
    return run.batches(positions(t, None), place(t), lambda b: on_roads(b, edges)).drop("batch")


@query("s2_challenge_stream", as_("s2_challenge_progress"))
def _(t):
    e = positions(t).select("user_id", "event_id", "ts", (F.col("x") / 50).alias("x"), (F.col("z") / 50).alias("z"), "speed", drive_route().alias("route"))
    return rounded(run.append(M.challenge_stream(e), place(t)), "elapsed", digits=3)


@query("s3_best_times_stream", as_("s3_best_time_stream"))
def _(t):
    best = M.best_times(events(t, None).select(F.col("event_type").alias("route"), F.col("value").alias("seconds")))
    return run.latest(run.batches(best, place(t), lambda b: b, "update"), "route")


@query("s4_cooldown_stream", "SELECT user_id, event_id FROM (" + as_("s4_request_cooldown") + ") WHERE accepted")
def _(t):
    return run.append(M.cooldown_stream(events(t).select("user_id", "event_id", "ts"), 43_200_000), place(t)).select("user_id", "event_id")


@query("s5_active_tiles_stream", "SELECT user_id, event_id FROM (" + as_("s5_active_tiles") + ")")
def _(t):
    tiles = T.world_tile(positions(t)).select("user_id", "event_id", "ts", F.col("tile").alias("signature"))
    return run.append(M.active_tiles_stream(tiles), place(t)).select("user_id", "event_id")


@query("s6_sampling_stream", as_("s6_telemetry_sampling"))
def _(t):
    sampled = M.sample_telemetry(positions(t), "1 hour").select("user_id", "slot", "event_id", "n")
    return run.latest(run.batches(sampled, place(t), lambda b: b, "update"), "user_id", "slot").select("user_id", F.col("slot").cast("timestamp_ntz").alias("slot"), "event_id", "n")


@query("s7_cache_ttl_stream", as_("s7_cache_ttl"))
def _(t):
    return run.append(M.cooldown_stream(events(t).select("user_id", "event_id", "ts"), TTL_MS), place(t)).select("user_id", "event_id")
