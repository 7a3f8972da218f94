"""Streams that run: file sources, folds with state, and sinks that can stop and resume from their checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ..operators.scan import Fold

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def files(spark: SparkSession, path: str, watermark: str | None = None, column: str = "ts", **options) -> DataFrame:
    """The rows of a folder (or file) of Parquet files as a stream; new files are new rows."""
    head, _, name = path.rstrip("/").rpartition("/")
    # as a pattern the path may name a file as well as a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(f"{head}/[{name[0]}]{name[1:]}")
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, watermark) if watermark else stream


class FoldProcessor(StatefulProcessor):
    """A fold over the rows of a key as they come: the rows of a batch are worked through in order of `order`, the state is kept
    between batches, and goes when the watermark is `idle_ms` past the key's last row."""

    def __init__(self, fold: Fold, order: list[str], name: str, idle_ms: int) -> None:
        self.fold, self.order, self.name, self.idle_ms = fold, order, name, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", StructType([StructField("fold", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(self.order)
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        columns = {c: table[c].to_numpy() for c in self.fold.columns}
        made = self.fold.inside(state, columns)
        self.state.update((json.dumps(self.fold.through(state, self.fold.summary(columns))),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = int(table["ts"].max().value // 1_000_000)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame({"key": key[0], self.name: table[self.name].to_numpy(), **{c: pd.Series(v, dtype=object) if v.dtype == object else v for c, v in made.items()}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, order: list[str], name: str, fold: Fold, idle_ms: int) -> DataFrame:
    """What segmented() gives, for a stream of rows (key, ts with a watermark, order, name and the columns of the fold)."""
    kinds, names = dict(rows.dtypes), {"bool": "boolean", "double": "double", "int32": "int", "int64": "long", "string": "string"}
    schema = f"key {kinds[key]}, {name} {kinds[name]}, " + ", ".join(f"{c} {names[str(k)]}" for c, k in fold.out.items())
    wanted = rows.select(*dict.fromkeys([key, "ts", *order, name, *fold.columns])).where(F.col(key).isNotNull())
    made = wanted.groupBy(key).transformWithStateInPandas(FoldProcessor(fold, order, name, idle_ms), _parse_datatype_string(schema), "append", "eventTime")
    return made.withColumnRenamed("key", key)


@contextmanager
def _state_store(spark: SparkSession):
    """Folds need a state store of their kind; the session's own choice is put back when the stream has begun."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def append(stream: DataFrame, path: str) -> DataFrame:
    """Work off what is there and stop; the rows written under `path`, each once. Called again, it goes on where it stopped."""
    spark = stream.sparkSession
    with _state_store(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def batches(stream: DataFrame, path: str, each: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """As append(), but each batch goes through `each`, which may be any batch operator; a batch that runs again replaces what
    it wrote. Rows carry their `batch`."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    with _state_store(spark):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows that were written batch by batch, the last of each key."""
    names = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), "batch").alias("last")).select(*key, "last.*")
