"""Exact dedup through a cuckoo-filter index of live digests (operator 5)."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, byte_texts, durable, join_skewed, parts_for, to_batch, whole_texts

WHITE_SPACE = b" \t\n\x0b\x0c\r"
#: Live digests that one part of the index holds; the number of parts follows the rows.
PART_DIGESTS = 50_000
GROUPS = "part int, digest binary, n_points long, keep_id long, group_size long"


class CuckooFilter:
    """Fingerprints of digests in buckets of four slots; the stored keys of each bucket verify hits and feed a resize.

    insert, contains and delete work on live digests. When an insertion finds no free slot after MAX_KICKS moves, the
    table doubles and is filled again from the stored keys.
    """

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, buckets: int = 1024) -> None:
        self.keys: dict[int, dict[bytes, object]] = {}
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask, self.table = buckets - 1, array("H", bytes(2 * self.SLOTS * buckets))

    @staticmethod
    def _fingerprint(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:6], "big"), int.from_bytes(digest[6:8], "big") or 1

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & self.mask

    def _slot(self, bucket: int, fp: int) -> int:
        at = bucket * self.SLOTS
        for i in range(at, at + self.SLOTS):
            if self.table[i] == fp:
                return i
        return -1

    def contains(self, digest: bytes) -> bool:
        """True for every live digest, and now and then for another one."""
        h, fp = self._fingerprint(digest)
        bucket = h & self.mask
        return self._slot(bucket, fp) >= 0 or self._slot(self._other(bucket, fp), fp) >= 0

    def _place(self, digest: bytes) -> bool:
        h, fp = self._fingerprint(digest)
        bucket = h & self.mask
        for kick in range(self.MAX_KICKS):
            for at in (bucket, self._other(bucket, fp)):
                if (i := self._slot(at, 0)) >= 0:
                    self.table[i] = fp
                    return True
            i = bucket * self.SLOTS + (kick * 7 + fp) % self.SLOTS
            fp, self.table[i] = self.table[i], fp
            bucket = self._other(bucket, fp)
        return False

    def insert(self, digest: bytes, content: object = None) -> bool:
        """Add a digest unless it is live already; tells whether it was added. A filter hit is verified exactly."""
        held = self.keys.setdefault(self._fingerprint(digest)[0], {})
        if self.contains(digest) and digest in held:
            return False
        held[digest] = content
        if not self._place(digest):
            self._resize()
        return True

    def get(self, digest: bytes) -> object:
        return self.keys.get(self._fingerprint(digest)[0], {}).get(digest) if self.contains(digest) else None

    def replace(self, digest: bytes, content: object) -> None:
        self.keys[self._fingerprint(digest)[0]][digest] = content

    def delete(self, digest: bytes) -> bool:
        h, fp = self._fingerprint(digest)
        if not self.contains(digest) or digest not in self.keys.get(h, {}):
            return False
        bucket = h & self.mask
        i = self._slot(bucket, fp)
        self.table[i if i >= 0 else self._slot(self._other(bucket, fp), fp)] = 0
        del self.keys[h][digest]
        return True

    def _resize(self) -> None:
        while True:
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            if all(self._place(d) for held in self.keys.values() for d in held):
                return

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((d, c) for held in self.keys.values() for d, c in held.items())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the text) and the SHA-256 of the text without white space, of each row."""
    schema = "doc_id long, n_points long, digest binary"
    src = whole_texts(docs, F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"))
    arrow = arrow_schema(src, schema)

    def run(batches):
        for b in batches:
            yield to_batch({"doc_id": b["doc_id"], "n_points": b["n_points"], "digest": [hashlib.sha256(t.translate(None, WHITE_SPACE)).digest() for t in byte_texts(b["text"])]}, arrow)

    return src.mapInArrow(run, schema)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (points, doc_id, rows): more code points, then the smaller id, and all rows."""
    first = min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    return first[0], first[1], a[2] + b[2]


def _combined(rows: DataFrame, parts: int) -> DataFrame:
    """One row per digest of each input partition, before the shuffle: a hot digest moves once per task."""
    arrow = arrow_schema(rows, GROUPS)

    def run(batches):
        held: dict[bytes, tuple] = {}

        def flush():
            keys, values = list(held), list(held.values())
            held.clear()
            return to_batch({"part": [int.from_bytes(k[-8:], "big") % parts for k in keys], "digest": keys, "n_points": [v[0] for v in values], "keep_id": [v[1] for v in values], "group_size": [v[2] for v in values]}, arrow)

        for b in batches:
            for d, n, i in zip(b["digest"].to_pylist(), b["n_points"].to_pylist(), b["doc_id"].to_pylist()):
                now = (n, i, 1)
                held[d] = _better(held[d], now) if d in held else now
            if len(held) > 200_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, GROUPS)


def live_index(rows: DataFrame, total: int, removed: DataFrame | None = None) -> DataFrame:
    """The live digests with the row that stays and the number of rows, after every row went through its part's filter.

    rows: digests(); removed: a table with `digest` of texts to delete from the index afterwards.
    """
    parts = parts_for(total, PART_DIGESTS)
    keyed = _combined(rows, parts)
    if removed is not None:
        gone = removed.select("digest").distinct().select(F.pmod(F.conv(F.substring(F.hex("digest"), 49, 16), 16, 10).cast("decimal(20,0)"), F.lit(parts)).cast("int").alias("part"), "digest", F.lit(-1).cast("long").alias("n_points"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
        keyed = keyed.unionByName(gone)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        live = CuckooFilter()
        part = int(pdf["part"].iloc[0])
        ids = pdf["keep_id"].astype(object).where(pdf["keep_id"].notna(), None)
        gone = []
        for d, n, i, k in zip(pdf["digest"], pdf["n_points"], ids, pdf["group_size"]):
            d = bytes(d)
            if not k:
                gone.append(d)
                continue
            now = (int(n), None if i is None else int(i), int(k))
            if not live.insert(d, now):
                live.replace(d, _better(live.get(d), now))
        for d in gone:
            live.delete(d)
        out = list(live.items())
        return pd.DataFrame({"part": [part] * len(out), "digest": [d for d, _ in out], "n_points": [c[0] for _, c in out], "keep_id": pd.array([c[1] for _, c in out], "Int64"), "group_size": [c[2] for _, c in out]})

    return keyed.repartition(parts, "part").groupBy("part").applyInPandas(index, GROUPS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blank, tab, line and page breaks; the row with the most code points
    stays, then the one with the smallest doc_id. Null texts count as empty, so null, empty and blank texts form one
    group. Rows with one doc_id count as one document: all of them carry the same verdict. A null doc_id loses ties and
    is never kept beside a row that has an id. An empty table gives no rows; other columns are ignored.
    """
    rows = durable(digests(docs))
    total = rows.count()
    groups = durable(live_index(rows, total).where("group_size > 1").select("digest", "keep_id", "group_size"))
    out = join_skewed(rows, groups, "digest", "group_size", total, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
