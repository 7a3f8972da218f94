"""Positions and requests as streams. Stateless parts run on batches and streams alike; stateful ones keep a few numbers per
key, with batch twins that fold the same steps over ordered rows in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..operators.scan import Accept, Changes, Drive, Smooth, segmented
from .run import folded

IDLE_MS = 3_600_000


def telemetry(matched: DataFrame) -> DataFrame:
    """speed_kph, road_name and off_road of positions with their matched road (distance, width, name, kind; nulls: none)."""
    return matched.withColumns({
        "speed_kph": half_up(F.abs("speed") * 3.6).cast("int"),
        "road_name": F.coalesce("name", F.replace("kind", F.lit("_"), F.lit(" ")), F.lit("No drivable road")),
        "off_road": F.coalesce(F.col("distance") > F.col("width") * 0.62 + 1.4, F.lit(True)),
    })


def sample_telemetry(events: DataFrame, every: str = "100 milliseconds", key: str = "user_id") -> DataFrame:
    """At most one row per key and interval: the last. Streams need a watermark on ts."""
    row = F.struct("ts", "event_id", "x", "z", "speed")
    return events.groupBy(key, F.window("ts", every)).agg(F.max_by(row, F.struct("ts", "event_id")).alias("r"), F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("slot"), "r.event_id", "r.x", "r.z", "r.speed", "n")


def best_times(finishes: DataFrame) -> DataFrame:
    return finishes.groupBy("route").agg(F.min("seconds").alias("best_seconds"))


def cooldown_batch(requests: DataFrame, ms: int = 2500, key: str = "user_id") -> DataFrame:
    """Requests (key, ts, event_id) with `accepted`: the first of a client, and each that comes `ms` or more after the last
    accepted one. Requests without a client or a time go."""
    rows = requests.select(key, F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id").where("at is not null")
    return segmented(rows, key, ["at", "event_id"], "event_id", Accept(ms))


def cooldown_stream(requests: DataFrame, ms: int = 2500, key: str = "user_id") -> DataFrame:
    """The accepted requests (key, event_id) of a stream (key, ts with a watermark, event_id); a client's state goes after an idle
    hour, or `ms` if that is longer."""
    rows = requests.withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    return folded(rows, key, ["at", "event_id"], "event_id", Accept(ms), max(ms, IDLE_MS)).where("accepted").drop("accepted")


def ewma(samples: DataFrame, response: float = 7.5, key: str = "user_id") -> DataFrame:
    """Smoothed values of samples (key, event_id, t in seconds, value): cur + (value - cur)(1 - exp(-max(0, dt) response)),
    starting at the first value. Samples without a key, a time or a value go."""
    return segmented(samples.where("t is not null and value is not null"), key, ["t", "event_id"], "event_id", Smooth(response))


def signature_changes(active: DataFrame, key: str = "user_id") -> DataFrame:
    """Of active tiles per position (key, event_id, ts, tile), the positions where a viewer's set of tiles changes."""
    sets = active.groupBy(key, "event_id", "ts").agg(F.array_join(F.array_sort(F.collect_set("tile")), "|").alias("signature"))
    changed = segmented(sets, key, ["ts", "event_id"], "event_id", Changes()).where("changed")
    return changed.join(sets, [key, "event_id"]).select(key, "event_id", "ts", "signature")


def active_tiles_stream(active: DataFrame, key: str = "user_id", idle_ms: int = IDLE_MS) -> DataFrame:
    """signature_changes() for a stream (key, ts with a watermark, event_id, signature): the last signature of each viewer is the
    state, which goes after an idle hour. Returns key, event_id."""
    return folded(active, key, ["ts", "event_id"], "event_id", Changes(), idle_ms).where("changed").drop("changed")


def drive_step(state: tuple, dt: float, x: float, z: float, speed: float, checkpoints: list) -> tuple:
    """One step of a drive: (status, elapsed, next checkpoint)."""
    status, elapsed, nxt = state
    if status == "ready" and abs(speed) > 1.2:
        status = "running"
    if status == "running":
        elapsed += dt
        cx, cz = checkpoints[nxt]
        if ((x - cx) ** 2 + (z - cz) ** 2) ** 0.5 <= 9:
            nxt += 1
            if nxt >= len(checkpoints):
                status = "finished"
    return status, elapsed, nxt


PROGRESS = "user_id long, event_id long, status string, elapsed double, checkpoint int"


def challenge_batch(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The state of each vehicle's drive after each event (user_id, event_id, ts, x, z, speed), on its own checkpoints
    (user_id, route array<(x, z)>; vehicles without a route of two points are left out, and events without a time or place)."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    route = checkpoints.where(F.size("route") >= 2).select("user_id", F.transform("route", lambda p: p["x"]).alias("rx"), F.transform("route", lambda p: p["z"]).alias("rz"))
    rows = events.select("user_id", "event_id", at, "x", "z", F.coalesce("speed", F.lit(0.0)).alias("speed")).dropna(subset=["at", "x", "z"]).join(route, "user_id")
    return segmented(rows, "user_id", ["at", "event_id"], "event_id", Drive())


def challenge_stream(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """challenge_batch() for a stream of events (ts with a watermark) that carry their `route`; a drive goes after an idle hour."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    axis = lambda c: F.transform("route", lambda p: p[c])
    rows = events.where(F.size("route") >= 2).select("user_id", "event_id", "ts", at, "x", "z", F.coalesce("speed", F.lit(0.0)).alias("speed"), axis("x").alias("rx"), axis("z").alias("rz")).dropna(subset=["at", "x", "z"])
    return folded(rows, "user_id", ["at", "event_id"], "event_id", Drive(), idle_ms)


def suppress_repeats(stream: DataFrame, key: str = "key", days: int = 7) -> DataFrame:
    """A stream without keys seen within the last days."""
    return stream.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark([key])
