"""Bloom filters sized by their keys, built slice by slice in tasks, and rows dropped by key without a shuffle of the other rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, to_batch

N_HASHES = 4
#: Bits of a filter for each of its keys; of a slice, which one task builds; and of the largest filter, 64 MB, which is broadcast.
#: With more than about 30 million keys the bits for each get fewer: more rows that are none of them pass, which costs a shuffle
#: of these rows and changes no result.
KEY_BITS, SLICE_BITS, MOST_BITS = 16, 1 << 20, 1 << 29


class Bloom:
    """A Bloom filter over 64-bit hashes, filled and asked for arrays of them. Hashes are dealt to `slices` by their low
    bits, so that a task which has all hashes of a slice builds that slice alone."""

    def __init__(self, bits: int, data: bytes | None = None, slices: int = 1) -> None:
        self.slices, self.width = slices, bits // slices
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def _at(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        start = hashes % np.uint64(self.slices) * np.uint64(self.width)
        for i in range(N_HASHES):
            yield start + ((a + np.uint64(i) * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(self.width)

    def add(self, hashes: np.ndarray) -> None:
        for at in self._at(hashes):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self._at(hashes):
            found &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def filter_of(hashes: DataFrame, bits: int | None = None) -> Bloom:
    """The filter of a column `hash` (durable: it is counted first, which sizes the filter). Each task fills one slice; all
    slices, at most MOST_BITS, come to the driver in one job."""
    bits = bits or min(max(1 << (KEY_BITS * hashes.count()).bit_length(), 1 << 16), MOST_BITS)
    slices = max(1, bits // SLICE_BITS)
    schema = "slice int, bits binary"
    arrow = arrow_schema(hashes, schema)
    width = bits // slices

    def run(batches):
        mine: dict[int, Bloom] = {}
        for b in batches:
            s, h = b["slice"].to_numpy(), b["hash"].to_numpy().view(np.uint64)
            for k in np.unique(s).tolist():
                mine.setdefault(k, Bloom(width)).add(h[s == k])
        for k, f in mine.items():
            yield to_batch({"slice": [k], "bits": [f.data.tobytes()]}, arrow)

    dealt = hashes.select("hash", F.col("hash").bitwiseAND(F.lit(slices - 1)).cast("int").alias("slice")).repartition(slices, "slice")
    whole = bytearray(bits // 8)
    for row in dealt.mapInArrow(run, schema).collect():
        whole[row["slice"] * (width // 8) : (row["slice"] + 1) * (width // 8)] = row["bits"]
    return Bloom(bits, bytes(whole), slices)


def row_keys(docs: DataFrame) -> dict:
    """Two 64-bit hashes of doc_id, text and lang, which name rows of equal content; nulls differ from all values."""
    parts = [x for c in ("doc_id", "text", "lang") if c in docs.columns for x in (docs[c].isNull(), docs[c].cast("string"))]
    return {"__key1": F.xxhash64(F.lit(1), *parts), "__key2": F.xxhash64(F.lit(2), *parts)}


def parted(docs: DataFrame, found: Bloom, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose 64-bit `key` the filter may have, and the others."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(k.fillna(0).to_numpy(np.int64).view(np.uint64)))

    return docs.where(maybe(key)), docs.where(~maybe(key))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns, less those whose row_keys() are in gone (__key1, __key2; durable, each once).

    Only rows that the filter of the keys names are shuffled to meet them; the others stay where they are.
    """
    maybe, others = parted(docs.withColumns(row_keys(docs)), filter_of(gone.select(F.col("__key1").alias("hash"))), "__key1")
    return maybe.join(gone.hint("merge"), ["__key1", "__key2"], "left_anti").select(docs.columns).unionByName(others.select(docs.columns))
