"""Streams that stop, resume and forget, against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from geoloom.streaming import run
from geoloom.streaming import telemetry as M

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROUTE = [(0.0, 0.0), (2.0, 9.0), (9.0, 18.0)]
SCHEMA = "user_id long, event_id long, ts timestamp, x double, z double, speed double, signature string"


def rows(n=240, seed=6):
    rnd = random.Random(seed)
    return [(1 if i % 3 == 0 else rnd.randint(2, 9), i, START + dt.timedelta(seconds=10 * i), rnd.uniform(0, 12), rnd.uniform(0, 12), rnd.choice([0.0, 3.0]), rnd.choice("ab")) for i in range(n)]


def in_parts(spark, tmp_path, build, *parts):
    """What a stream gives that stops after each part and is started anew from its checkpoint for the next."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run.append(build(run.files(spark, str(tmp_path / "in"), "1 second")), str(tmp_path / "out"))
    return sorted(map(tuple, out.collect()))


def test_cooldown_resumes(spark, tmp_path):
    data = rows()
    want = M.cooldown_batch(spark.createDataFrame(data, SCHEMA), 45_000).where("accepted").select("user_id", "event_id")
    assert in_parts(spark, tmp_path, lambda s: M.cooldown_stream(s, 45_000), data[:70], data[70:75], data[75:]) == sorted(map(tuple, want.collect()))


def test_drives_resume(spark, tmp_path):
    data = rows()
    route = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in ROUTE])
    df = spark.createDataFrame(data, SCHEMA)
    want = M.challenge_batch(df, df.select("user_id").distinct().withColumn("route", route))
    got = in_parts(spark, tmp_path, lambda s: M.challenge_stream(s.withColumn("route", route)), data[:30], data[30:170], data[170:])
    assert got == sorted(map(tuple, want.collect())) and {r[2] for r in got} == {"ready", "running", "finished"}


def test_tiles_resume_and_are_forgotten(spark, tmp_path):
    data = rows()
    want = M.signature_changes(spark.createDataFrame(data, SCHEMA).withColumnRenamed("signature", "tile")).select("user_id", "event_id")
    assert in_parts(spark, tmp_path / "a", M.active_tiles_stream, data[:100], data[100:]) == sorted(map(tuple, want.collect()))
    one = (5, 1, START, 0.0, 0.0, 0.0, "a")
    # a later viewer moves the watermark on; a key's last signature is kept for the idle time and then goes
    other = (6, 2, START + dt.timedelta(hours=3), 0.0, 0.0, 0.0, "a")
    same = (5, 3, START + dt.timedelta(hours=4), 0.0, 0.0, 0.0, "a")
    assert in_parts(spark, tmp_path / "b", M.active_tiles_stream, [one], [other], [same]) == [(5, 1), (5, 3), (6, 2)]
    assert in_parts(spark, tmp_path / "c", lambda s: M.active_tiles_stream(s, idle_ms=10 * 3_600_000), [one], [other], [same]) == [(5, 1), (6, 2)]


def test_batches_go_through_an_operator_once(spark, tmp_path):
    data, seen = rows(40), []

    def each(batch):
        seen.append(batch.count())
        return batch.select("event_id")

    for part in (data[:15], data[15:], []):
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run.batches(run.files(spark, str(tmp_path / "in")), str(tmp_path / "out"), each)
    assert seen == [15, 25] and sorted(r["event_id"] for r in out.collect()) == list(range(40))


def test_the_state_store_of_the_session_stays(spark, tmp_path):
    before = spark.conf.get(run.PROVIDER[0], None)
    in_parts(spark, tmp_path, M.cooldown_stream, rows(5))
    assert spark.conf.get(run.PROVIDER[0], None) == before
