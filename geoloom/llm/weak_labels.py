"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed scorer (operator 9)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, byte_texts, durable, to_batch, whole_texts
from .hashed_model import fit, posteriors
from .quality_rules import SYMBOLS

# Words of abuse that one labeller looks for.
ABUSE = (b"worthless", b"trash", b"disgusting", b"stupid", b"idiot", b"moron", b"pathetic")
LABELLERS = ("symbols", "symbol_words", "letters", "lines", "variety", "word_length", "sentences", "length", "abuse", "capitals")
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
#: The document is kept if the scorer's probability of good quality reaches this.
KEEP_AT = 0.5
ROUNDS = 50


def votes(text: bytes) -> str:
    """One character per labeller: '+' good, '-' bad, '0' no vote."""
    words = text.split()
    n = len(words)
    if not n:
        return "".join("-" if k == "length" else "0" for k in LABELLERS)
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    symbols = (len(text) - len(text.translate(None, SYMBOLS))) / len(text)
    marked = sum(len(w) != len(w.translate(None, SYMBOLS)) for w in words) / n
    letters = len(text.translate(None, NO_LETTERS)) / sum(map(len, words))
    distinct = len(set(words)) / n
    size = sum(map(len, words)) / n
    ended = sum(x[-1:] in b".!?:\"" for x in lines) / len(lines)
    lower = text.lower()
    caps = sum(w[:1].isupper() and w.isupper() for w in words) / n
    marks = {
        "symbols": "-" if symbols > 0.02 else "+",
        "symbol_words": "-" if marked > 0.15 else "+" if marked < 0.02 else "0",
        "letters": "-" if letters < 0.88 else "+" if letters > 0.93 else "0",
        "lines": "-" if len(set(lines)) < 0.7 * len(lines) else "+" if len(lines) > 4 else "0",
        "variety": "0" if n < 30 else "-" if distinct < 0.25 else "+",
        "word_length": "-" if size < 2.5 or size > 14 else "+",
        "sentences": "-" if ended < 0.5 else "+",
        "length": "-" if n < 10 else "+" if n >= 40 else "0",
        "abuse": "-" if sum(lower.count(x) for x in ABUSE) * 200 > n else "0",
        "capitals": "-" if caps > 0.3 else "0" if caps > 0.05 else "+",
    }
    return "".join(marks[k] for k in LABELLERS)


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[np.ndarray, float, dict[str, float]]:
    """Accuracies of the labellers, the share of good documents, and each pattern's posterior of good.

    patterns: how many documents have each pattern of votes, at most 3 ** len(LABELLERS) of them. The true class is
    hidden; labellers err independently given it, each with its own rates of '+', '-' and '0' in either class.
    """
    if not patterns:
        return np.full(len(LABELLERS), 0.5), 0.5, {}
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    vote = np.array([["+-0".index(c) for c in k] for k in keys])
    bad = (vote == 1).sum(axis=1)
    good = np.where(bad == 0, 0.95, np.where(bad == 1, 0.5, 0.05))
    for _ in range(rounds):
        share = np.clip((weight * good).sum() / weight.sum(), 0.02, 0.98)
        rates = np.stack([np.stack([np.bincount(vote[:, j], weights=weight * p, minlength=3) + [1, 1, 1] for j in range(vote.shape[1])]) for p in (good, 1 - good)])
        rates /= rates.sum(axis=2, keepdims=True)
        logs = np.log(rates)
        at = np.arange(vote.shape[1])
        x = np.log(share / (1 - share)) + (logs[0, at, vote] - logs[1, at, vote]).sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    spoken = rates[:, :, :2] / rates[:, :, :2].sum(axis=2, keepdims=True)
    accuracy = share * spoken[0, :, 0] + (1 - share) * spoken[1, :, 1]
    return accuracy, float(share), dict(zip(keys, good.tolist()))


def with_votes(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, votes string"
    arrow = arrow_schema(docs, schema)

    def run(batches):
        for b in batches:
            yield to_batch({"doc_id": b["doc_id"], "votes": [votes(t) for t in byte_texts(b["text"])]}, arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior (of good, by the labellers), score (of good, by the hashed scorer) and kept.

    Labeller accuracies come from the votes on all documents; the scorer is trained on posteriors of a bounded sample
    (hashed_model.TRAIN_DOCS) and applied to every whole text; a document is kept when posterior and score together
    (their mean) reach KEEP_AT. A null or empty text counts as too short. Repeated rows count each time; an empty table
    gives no rows; other columns are ignored.
    """
    src = whole_texts(docs)
    spark = docs.sparkSession
    seen = durable(with_votes(src))
    # at most 3 ** len(LABELLERS) patterns, whatever the corpus
    _, _, good = estimate({r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()})
    table = spark.createDataFrame(list(good.items()), "votes string, posterior double")
    targets = seen.where("doc_id is not null").join(F.broadcast(table), "votes").select("doc_id", F.array(F.col("posterior"), 1 - F.col("posterior")).alias("target"))
    shared = spark.sparkContext.broadcast((fit(src, targets, 2).astype(np.float32), good))
    schema = "doc_id long, votes string, posterior double, score double, kept boolean"
    arrow = arrow_schema(docs, schema)

    def run(batches):
        weights, table = shared.value
        for b in batches:
            raw = byte_texts(b["text"])
            marks = [votes(t) for t in raw]
            p = np.array([table[v] for v in marks])
            s = posteriors(raw, weights)[:, 0]
            yield to_batch({"doc_id": b["doc_id"], "votes": marks, "posterior": p, "score": s, "kept": (p + s) / 2 >= KEEP_AT}, arrow)

    return src.mapInArrow(run, schema)
