"""SimHash near-dedup: fingerprints embedded as bit counts of segments, a grid join under Manhattan distance, exact
verification, components (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, byte_texts, chunks, durable, join_skewed, map_batches, parts_for, to_batch, whole_texts
from .components import components

SEED = 42
#: Segments of a fingerprint. More of them make the Manhattan bound tighter and each fingerprint's cells more numerous
#: (2 * SEGMENTS + 1): with 16, random fingerprints share a cell with a probability of about 3e-7.
SEGMENTS = 16
#: Runs of one cell up to this length are compared pair by pair, longer ones through common midpoints.
SMALL_RUN = 24
CELL_ROWS = 400_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; zero without a word."""
    return int(fingerprints([text], shingle)[0])


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHashes of many texts: bits that more than half of a text's shingle hashes have."""
    hashes, counts = [], []
    xxh, step = xxhash.xxh64_intdigest, shingle - 1
    for t in texts:
        words = t.lower().split()
        if len(words) <= step:
            hashes.extend([xxh(b" ".join(words), SEED)] if words else [])
            counts.append(1 if words else 0)
        else:
            line, ends, at = b" ".join(words), [], -1
            for n in map(len, words):
                at += n + 1
                ends.append(at)
            starts = [0, *[e + 1 for e in ends]]
            hashes.extend([xxh(line[a:b], SEED) for a, b in zip(starts, ends[step:])])
            counts.append(len(words) - step)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    h = np.array(hashes, np.uint64)
    full = np.flatnonzero(n)
    starts = np.zeros(len(full), np.int64)
    np.cumsum(n[full][:-1], out=starts[1:])
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""

    def run(batch: pa.RecordBatch) -> dict:
        raw = byte_texts(batch["text"])
        got = [fingerprints(raw[a:b], shingle) for a, b in chunks(raw)]
        return {"doc_id": batch["doc_id"], "fp": np.concatenate(got).view(np.int64)}

    return map_batches(whole_texts(docs), run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The embedding: the number of set bits in each segment of the fingerprints."""
    width = 64 // segments
    at = np.arange(segments, dtype=np.uint64) * np.uint64(width)
    return np.bitwise_count((fp[:, None] >> at) & np.uint64((1 << width) - 1))


def _cell_weights(segments: int) -> np.ndarray:
    """Odd 64-bit factors, a hash of the segment number; a grid cell's id is the weighted sum of its counts."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(2, "little"), SEED) | 1 for i in range(segments)], np.uint64)


def cells(distinct: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """fp and the grid cells that it falls into: its own and those one step away.

    Two fingerprints that differ in at most 2 bits lie at most 2 apart in Manhattan distance, so some grid point is at
    most one step from both, and they meet in its cell. Cells whose ids collide only bring more candidates.
    """
    schema = "cell long, fp long"
    arrow = arrow_schema(distinct, schema)
    weights = _cell_weights(segments)

    def run(batches):
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for a in range(0, len(fp), 50_000):
                f = fp[a : a + 50_000]
                own = (segment_counts(f, segments).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                every = np.concatenate([own[:, None], own[:, None] + weights, own[:, None] - weights], axis=1)
                yield to_batch({"cell": every.ravel().view(np.int64), "fp": np.repeat(f, every.shape[1]).view(np.int64)}, arrow)

    return distinct.select("fp").mapInArrow(run, schema)


def _run_links(cell: np.ndarray, fp: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what the verified pairs of each cell connect; rows come sorted by cell."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    us, vs = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    c, f = cell[small], fp[small]
    for k in range(1, min(SMALL_RUN, len(c))):
        close = (c[k:] == c[:-k]) & (np.bitwise_count(f[k:] ^ f[:-k]) <= most_bits)
        if not (c[k:] == c[:-k]).any():
            break
        us.append(f[k:][close])
        vs.append(f[:-k][close])
    for a, n in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN]):
        u, v = _midpoint_links(np.unique(fp[a : a + n]), most_bits)
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _midpoint_links(f: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints at 2 or fewer bits share a word at one bit or less from both: link each to the first that has it."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    if most_bits < 2:
        flips = flips[:1] if most_bits < 1 else flips
    mid = (f[:, None] ^ flips).ravel()
    who = np.repeat(np.arange(len(f)), len(flips))
    order = np.argsort(mid, kind="stable")
    mid, who = mid[order], who[order]
    same = mid[1:] == mid[:-1]
    u, v = f[who[1:][same]], f[who[:-1][same]]
    good = np.bitwise_count(u ^ v) <= most_bits
    return _spanning(f, who[1:][same][good], who[:-1][same][good])


def _spanning(f: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link for each fingerprint to the first of its part, instead of all links (u, v) between positions of f."""
    root = np.arange(len(f))
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            break
        root = low
    far = np.flatnonzero(root != np.arange(len(f)))
    return f[far], f[root[far]]


def links(distinct: DataFrame, count: int, segments: int = SEGMENTS, most_bits: int = 2) -> DataFrame:
    """u, v: fingerprints at most `most_bits` (2 or fewer) apart, enough of them to connect all that are linked.

    Rows meet by cell in sorted partitions; a cell's rows are worked on as they stream by, and a cell never gathers
    copies, only distinct fingerprints.
    """
    if most_bits > 2:
        raise ValueError("cells one step away guarantee at most 2 differing bits")
    schema = "u long, v long"
    met = cells(distinct, segments).repartition(parts_for(count * (2 * segments + 1), CELL_ROWS), "cell").sortWithinPartitions("cell")
    arrow = arrow_schema(met, schema)

    def run(batches):
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            cell = np.concatenate([cell, b["cell"].to_numpy()])
            fp = np.concatenate([fp, b["fp"].to_numpy().view(np.uint64)])
            if not len(cell):
                continue
            whole = np.searchsorted(cell, cell[-1])  # the last cell may go on in the next batch
            if whole:
                u, v = _run_links(cell[:whole], fp[:whole], most_bits)
                yield to_batch({"u": u.view(np.int64), "v": v.view(np.int64)}, arrow)
                cell, fp = cell[whole:], fp[whole:]
        if len(cell):
            u, v = _run_links(cell, fp, most_bits)
            yield to_batch({"u": u.view(np.int64), "v": v.view(np.int64)}, arrow)

    return met.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Texts are lower-cased in A-Z and cut at ASCII white space. A text with fewer words than a shingle hashes as one
    sequence; a null, empty or blank text has fingerprint zero and links like any other. Repeated rows fall into one
    component. Rows without a doc_id get a component_id only from linked rows that have one. An empty table gives no
    rows; other columns are ignored.
    """
    rows = durable(with_fingerprints(docs, shingle))
    total = rows.count()
    groups = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("held")))
    found = components(links(groups, groups.count(), segments, most_bits))
    linked = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = durable(linked)
    # a component may have most of the fingerprints: its least id comes from a partial aggregation, and goes back by size
    least = durable(linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    alone = linked.join(least.where("members = 1").select("root"), "root", "left_semi").select("fp", "held", F.col("first_id").alias("component_id"))
    joined = join_skewed(linked.select("root", "fp", "held"), least.where("members > 1"), "root", "members", total).select("fp", "held", "component_id")
    labels = durable(alone.unionByName(joined))
    out = join_skewed(rows, labels, "fp", "held", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = 3, most_bits: int = 2) -> DataFrame:
    """The documents, all columns, of which one of each component stays: the smallest doc_id, once if rows repeat it.

    Rows without a doc_id stand for no group, so they go.
    """
    kept = near_duplicates(docs, shingle, most_bits).where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    out = docs.where(docs["doc_id"].isNotNull()).join(kept, docs["doc_id"].cast("long") == F.col("__kept_id"), "left_semi")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return out.withColumn("__row", F.row_number().over(once)).where("__row = 1").select(docs.columns)
