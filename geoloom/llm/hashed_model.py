"""A softmax model over hashed byte grams of whole texts, trained on a bounded sample, applied to all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, byte_texts, chunks, durable, joined, to_batch

BITS, GRAM = 15, 5
#: The training sample: at most so many labelled documents, the smallest by a hash of doc_id, with their whole texts.
TRAIN_DOCS = 2000
STEPS, RATE = 60, 0.3
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed grams of texts one after the other (a text shorter than a gram is padded with blanks), and their numbers."""
    data, offsets = joined([t.translate(_LOWER) + b" " * max(1, GRAM - len(t)) for t in texts])
    h = np.zeros(max(len(data) - GRAM + 1, 0), np.uint32)
    for k in range(GRAM):
        h += (data[k : len(data) - GRAM + 1 + k].astype(np.uint32) + np.uint32(1)) * _FACTORS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    n = np.diff(offsets) - GRAM + 1
    at = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return (h >> np.uint32(32 - BITS))[at].astype(np.int32), n


def posteriors(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Class probabilities of each text, a row per text; weights: one row per class, the bias last."""
    out = []
    for a, z in chunks(texts):
        g, n = grams(texts[a:z])
        starts = np.cumsum(n) - n
        out.append(np.stack([np.add.reduceat(w[:-1][g], starts) / n + w[-1] for w in weights], axis=1))
    x = np.concatenate(out) if out else np.zeros((0, len(weights)))
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], targets: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights that give the targets (a row of class probabilities per text), by full-batch Adam steps."""
    k = targets.shape[1]
    w = np.zeros((k, (1 << BITS) + 1))
    if not len(texts):
        return w
    # a text as its distinct grams (at most 2 ** BITS) and their shares; texts are read a chunk at a time
    rows, cols, shares = [], [], []
    for a, z in chunks(texts):
        g, n = grams(texts[a:z])
        key, count = np.unique(np.repeat(np.arange(z - a), n).astype(np.int64) << BITS | g, return_counts=True)
        rows.append(((key >> BITS) + a).astype(np.int32))
        cols.append((key & ((1 << BITS) - 1)).astype(np.int32))
        shares.append((count / n[key >> BITS]).astype(np.float32))
    row, col, share = np.concatenate(rows), np.concatenate(cols), np.concatenate(shares)
    starts = np.searchsorted(row, np.arange(len(texts)))
    prior = targets.mean(axis=0).clip(1e-6)
    w[:, -1] = np.log(prior)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        x = np.stack([np.add.reduceat(w[c].astype(np.float32)[col] * share, starts, dtype=np.float64) + w[c, -1] for c in range(k)], axis=1)
        e = np.exp(x - x.max(axis=1, keepdims=True))
        miss = (e / e.sum(axis=1, keepdims=True) - targets) / len(texts)
        grad = np.stack([np.append(np.bincount(col, weights=miss[:, c].astype(np.float32)[row] * share, minlength=1 << BITS), miss[:, c].sum()) for c in range(k)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = RATE * 4 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        step[:, -1] *= 0.02
        w -= step
    return w


def fit(docs: DataFrame, targets: DataFrame, classes: int) -> np.ndarray:
    """Weights from a bounded sample: of the documents (doc_id, text) with a target (doc_id, target array<double>),
    TRAIN_DOCS by a hash of doc_id. Ids alone are joined and sorted; the whole texts of the bounded list of ids are then read
    by a broadcast of that list. One task trains, and the weights alone reach the driver."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = durable(docs.where("doc_id is not null").select("doc_id").join(targets, "doc_id").dropDuplicates(["doc_id"]).orderBy(*order).limit(TRAIN_DOCS))
    sample = docs.join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("text")).limit(TRAIN_DOCS)
    schema = "weights binary"
    arrow = arrow_schema(docs, schema)

    def run(batches):
        texts, aims = [], []
        for b in batches:
            texts += byte_texts(b["text"])
            aims += b["target"].to_pylist()
        yield to_batch({"weights": [train(texts, np.array(aims, float).reshape(-1, classes)).astype(np.float32).tobytes()]}, arrow)

    got = sample.select("text", "target").coalesce(1).mapInArrow(run, schema).collect()
    return np.frombuffer(got[0]["weights"], np.float32).reshape(classes, -1).astype(float) if got else np.zeros((classes, (1 << BITS) + 1))
