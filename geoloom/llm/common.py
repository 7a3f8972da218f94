"""What the corpus operators share: reading, durable intermediate tables, Arrow batches of whole texts, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than one in HOT_SHARE of the rows counts as hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1024
#: Bytes of text that one step of a vectorised kernel works on.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python. Batches bounded by rows alone grow with the texts, on both sides.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        conf = tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def durable(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/geoloom-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_texts(docs: DataFrame, *more) -> DataFrame:
    """doc_id and the whole text (null: empty); only these columns, so that no extra column can clash. Texts go to Python in
    batches of about BATCH_BYTES (a longer one alone, whole) unless the session has a size of its own."""
    if docs.sparkSession.conf.get(BATCH_SETTING, None) is None:
        docs.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """fn over Arrow batches; a dict of columns becomes a batch of the schema."""
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in _schema(df, schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield to_batch(fn(batch), arrow)

    return df.mapInArrow(run, schema)


def to_batch(columns: dict | pa.RecordBatch, arrow: pa.Schema) -> pa.RecordBatch:
    if isinstance(columns, pa.RecordBatch):
        return columns
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in _schema(df, schema)])


def _schema(df: DataFrame, schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def byte_texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text stands alone, whole."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and the offsets of each."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose `key` is unique and whose `weight` says how many rows of left have it.

    Keys with more than total / HOT_SHARE rows (at most HOT_SHARE of them, whatever the input) are broadcast, so no task
    gathers them; the others meet in a shuffle. left should be durable: it is read twice.
    """
    cut = max(total // HOT_SHARE, 256)
    hot, cold = right.where(F.col(weight) > cut), right.where(F.col(weight) <= cut)
    names = F.broadcast(hot.select(key))
    a = left.join(F.broadcast(hot), key, "inner")
    b = left.join(names, key, "left_anti").join(cold, key, how)
    return a.unionByName(b.select(a.columns))


def parts_for(rows: int, per_part: int, least: int = 12) -> int:
    return max(least, -(-rows // per_part))
