"""Line dedup: two Bloom filters name the suspected repeats, which alone shuffle for an exact confirmation (operator 7)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, filter_of, parted
from .common import arrow_schema, byte_texts, durable, join_skewed, to_batch, whole_texts

STRIP = b" \t\n\x0b\x0c\r"
MIN_POINTS = 10
#: Bits of the once-seen filter of one segment of the hash space; segments grow in number with the corpus.
SEGMENT_BITS = 1 << 23
FLUSH = 1_000_000


def keys_of(text: bytes) -> dict[bytes, list[int]]:
    """The keys of at least MIN_POINTS code points in a text, with the ordinals of their lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= MIN_POINTS:
            key = line.strip(STRIP).lower()
            if len(key) >= 4 * MIN_POINTS or len(key) >= MIN_POINTS and len(key.decode()) >= MIN_POINTS:
                if key in found:
                    found[key].append(i)
                else:
                    found[key] = [i]
    return found


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def line_hashes(docs: DataFrame, segments: int) -> DataFrame:
    """segment, hash, twice: each key's hash once per task, before any shuffle; twice if two documents of the task have it."""
    schema = "segment int, hash long, twice boolean"
    arrow = arrow_schema(docs, schema)

    def run(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return to_batch({"segment": (h % np.uint64(segments)).astype(np.int32), "hash": h.view(np.int64), "twice": n > 1}, arrow)

        for b in batches:
            for t in byte_texts(b["text"]):
                h = np.fromiter(map(_hash, keys_of(t)), np.uint64)
                held.append(h)
                size += len(h)
            if size > FLUSH:
                yield flush()
                size = 0
        yield flush()

    return docs.mapInArrow(run, schema)


def twice_seen(hashes: DataFrame, segments: int) -> Bloom:
    """The twice-seen filter: each segment's hashes go through a once-seen filter of their own, and those that it had already,
    or that came as seen twice, fill the twice-seen filter, which is sized by how many they are."""
    arrow = arrow_schema(hashes, "hash long")

    def run(batches):
        once: dict[int, Bloom] = {}
        for b in batches:
            seg, h, twice = b["segment"].to_numpy(), b["hash"].to_numpy().view(np.uint64), b["twice"].to_numpy(zero_copy_only=False)
            for s in np.unique(seg).tolist():
                mine = seg == s
                u, at, n = np.unique(h[mine], return_inverse=True, return_counts=True)
                flagged = np.zeros(len(u), bool)
                np.logical_or.at(flagged, at, twice[mine])
                seen = once.setdefault(s, Bloom(SEGMENT_BITS))
                yield to_batch({"hash": u[seen.has(u) | flagged | (n > 1)].view(np.int64)}, arrow)
                seen.add(u)

    return filter_of(durable(hashes.repartition(segments, "segment").mapInArrow(run, "hash long").distinct()))


def _suspected_lines(docs: DataFrame, twice: Bloom) -> DataFrame:
    """doc_id, key, its digest and the ordinals of its lines in the document, for keys that the twice-seen filter may have."""
    schema = "doc_id long, key binary, digest binary, lines array<int>"
    arrow = arrow_schema(docs, schema)
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches):
        for b in batches:
            held, hashes = [], []
            for d, t in zip(b["doc_id"].to_pylist(), byte_texts(b["text"])):
                if d is not None:
                    for key, lines in keys_of(t).items():
                        held.append((d, key, lines))
                        hashes.append(_hash(key))
            chosen = [held[i] for i in np.flatnonzero(shared.value.has(np.array(hashes, np.uint64)))]
            yield to_batch({"doc_id": [x[0] for x in chosen], "key": [x[1] for x in chosen], "digest": [xxhash.xxh3_128_digest(x[1]) for x in chosen], "lines": [x[2] for x in chosen]}, arrow)

    return docs.mapInArrow(run, schema)


def drops(docs: DataFrame) -> DataFrame:
    """doc_id and the ordinals of the lines that it loses, for each document that loses one.

    Keys are confirmed as whole texts, once for each task that has them; their documents meet them by 128-bit digests. That
    no two confirmed keys share a digest is checked.
    """
    segments = 1 << max(4, (2 * docs.rdd.getNumPartitions() - 1).bit_length())
    lines = durable(_suspected_lines(docs, twice_seen(line_hashes(docs, segments), segments)))
    total = lines.count()
    held = lines.groupBy("key", "digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("held"))
    confirmed = durable(held.where("first_id < last_id").select("digest", "first_id", "held"))
    n, different = confirmed.agg(F.count(F.lit(1)), F.countDistinct("digest")).first()
    if n != different:
        raise RuntimeError("two lines share a 128-bit digest")
    lost = join_skewed(lines.select("doc_id", "digest", "lines"), confirmed, "digest", "held", total).where("doc_id > first_id")
    return lost.groupBy("doc_id").agg(F.flatten(F.collect_list("lines")).alias("lines"))


def _without_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with `__lost`, the ordinals of the lines that they lose (null: none). Only documents that may lose
    one are shuffled."""
    lost = durable(drops(whole_texts(docs))).select(F.col("doc_id").alias("__lost_id"), F.col("lines").alias("__lost"))
    keyed = docs.withColumn("__id", docs["doc_id"].cast("long"))
    maybe, others = parted(keyed.withColumn("__key", F.xxhash64("__id")), filter_of(lost.select(F.xxhash64("__lost_id").alias("hash"))), "__key")
    met = maybe.join(lost.hint("merge"), maybe["__id"] == lost["__lost_id"], "left").select(*docs.columns, "__lost")
    return met.unionByName(others.select(*docs.columns, F.lit(None).cast("array<int>").alias("__lost")))


def kept_text(text: bytes, lost: list[int] | None) -> tuple[bytes, int, int]:
    """The text without the lost lines, its lines before, and those lost."""
    if not lost:
        return text, text.count(b"\n") + 1, 0
    lines, gone = text.split(b"\n"), set(lost)
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def dedup_lines(docs: DataFrame, digest_only: bool = False) -> DataFrame:
    """Drop repeated lines: of a key of at least ten code points that two documents hold, all lines go except those in
    the smallest doc_id holding it.

    Returns doc_id, n_lines, n_dropped and the kept text (digest_only: kept_sha256, its SHA-256, instead). A null or
    empty text is one empty line. Rows with one doc_id count as one document, so they lose nothing to each other; rows
    without a doc_id neither lose lines nor make others lose them. An empty table gives no rows; other columns are ignored.
    """
    name = "kept_sha256 string" if digest_only else "text string"
    schema = f"doc_id long, n_lines long, n_dropped long, {name}"
    src = _without_lines(whole_texts(docs))
    arrow = arrow_schema(src, schema)

    def run(batches):
        for b in batches:
            got = [kept_text(t, x) for t, x in zip(byte_texts(b["text"]), b["__lost"].to_pylist())]
            last = [hashlib.sha256(g[0]).hexdigest() for g in got] if digest_only else pa.array([g[0] for g in got], pa.binary()).cast(pa.string())
            yield to_batch({"doc_id": b["doc_id"], "n_lines": [g[1] for g in got], "n_dropped": [g[2] for g in got], name.split()[0]: last}, arrow)

    return src.mapInArrow(run, schema)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with their texts less the repeated lines; a null text stays null. Rows without a doc_id
    keep their texts."""
    cut = F.array_join(F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("__lost", i), x)), lambda x: x.isNotNull()), "\n")
    return _without_lines(docs).withColumn("text", F.when(F.col("__lost").isNull(), F.col("text")).otherwise(cut)).select(docs.columns)
