"""Mixing to target weights by soft membership: posteriors of domains, document rates by projected gradients (operator 4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import drop_rows, row_keys
from .common import arrow_schema, byte_texts, durable, to_batch, whole_texts
from .hashed_model import fit, posteriors

DOMAINS = ("clean", "low", "toxic")
#: Shares of the mix's tokens that the domains are to have.
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}
#: Most copies of a document in the mix, and gradient steps.
MOST_COPIES, STEPS, TOLERANCE = 4.0, 60, 1e-4
#: Steps between two times that the rates are written down.
WRITE_EVERY = 4


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and its domain's number: toxic before low before clean; a document with unlike labels is taken once."""
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def memberships(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row_keys(), tokens (words of the whole text) and the posterior of each domain, by a classifier of labelled documents."""
    src = whole_texts(docs, *[c.alias(k) for k, c in row_keys(docs).items()])
    k = len(DOMAINS)
    target = F.array(*[F.when(F.col("domain") == i, 1.0).otherwise(0.0) for i in range(k)])
    weights = fit(src.select("doc_id", "text"), domain_of(labels).select("doc_id", target.alias("target")), k)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = f"doc_id long, __key1 long, __key2 long, tokens long, {', '.join(f'p_{d} double' for d in DOMAINS)}"
    arrow = arrow_schema(docs, schema)

    def run(batches):
        for b in batches:
            raw = byte_texts(b["text"])
            p = posteriors(raw, shared.value)
            yield to_batch({c: b[c] for c in ("doc_id", "__key1", "__key2")} | {"tokens": [len(t.split()) for t in raw]} | {f"p_{d}": p[:, i] for i, d in enumerate(DOMAINS)}, arrow)

    return src.mapInArrow(run, schema)


def _sums(rows: DataFrame, most_copies: float) -> tuple[np.ndarray, np.ndarray]:
    """The domains' expected tokens under `rate`, and the Gram matrix of the documents whose rate no bound holds: a few
    numbers from partial sums."""
    k = len(DOMAINS)
    a = [F.col("tokens") * F.col(f"p_{d}") for d in DOMAINS]
    free = ((F.col("rate") > F.col("least_rate")) & (F.col("rate") < most_copies)).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.sum(a[i] * F.col("rate")) for i in range(k)], *[F.sum(a[i] * a[j] * free) for i, j in pairs]).first()
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, got[k:]):
        gram[i, j] = gram[j, i] = x or 0.0
    return np.array([x or 0.0 for x in got[:k]]), gram


def fit_rates(rows: DataFrame, targets: dict[str, float] = TARGETS, most_copies: float = MOST_COPIES, total: float | None = None, keep_clean: bool = False) -> DataFrame:
    """rows (doc_id, tokens, p_*) with `rate`: 0 <= rate <= most_copies, by projected-gradient least squares.

    Minimised: the squared gap between the domains' expected token totals and targets * total. A step moves every rate
    along its gradient, scaled by the inverse Gram matrix of the documents that are free to move, and projects it on the
    bounds; a step that widens the gap is halved. It needs a few sums alone, so the rates never leave the executors.
    total: tokens of the mix; None: as many as the scarcest domain allows without taking it more than once on average.
    keep_clean: documents to which no domain is likelier than clean have a rate of 1 at least, the clean tokens make up
    their share of the mix, and the other domains' targets are upper bounds, which a scarce domain misses.
    """
    k = len(DOMAINS)
    share = np.array([targets[d] for d in DOMAINS], float)
    share /= share.sum()
    a = [F.col("tokens") * F.col(f"p_{d}") for d in DOMAINS]
    held = F.col("p_clean") >= F.greatest(*[F.col(f"p_{d}") for d in DOMAINS]) if keep_clean else F.lit(False)
    state = rows.withColumn("rate", F.lit(1.0)).withColumn("least_rate", F.when(held, 1.0).otherwise(0.0))
    sums, gram = _sums(state.withColumn("least_rate", F.when(held, 1.0).otherwise(-1.0)), most_copies + 1)
    if not sums.any():
        return state.drop("least_rate")
    moves = [i for i in range(k) if not (keep_clean and DOMAINS[i] == "clean")]
    if total is None and keep_clean:
        total = sums[DOMAINS.index("clean")] / share[DOMAINS.index("clean")]
    elif total is None:
        total = min(sums[i] / share[i] for i in range(k) if share[i] > 0 and sums[i] > 0)
    want = np.minimum(share * total, sums) if keep_clean else share * total
    length = 1.0
    for step in range(1, STEPS + 1):
        gap, part = (sums - want)[moves], gram[np.ix_(moves, moves)]
        if np.abs(gap).max() <= TOLERANCE * total or length < 1e-3:
            break
        g = np.linalg.pinv(part + np.eye(len(moves)) * 1e-9 * max(np.trace(part), 1.0), hermitian=True) @ gap * length
        moved = F.col("rate") - sum((a[i] * F.lit(float(x)) for i, x in zip(moves[1:], g[1:])), a[moves[0]] * F.lit(float(g[0])))
        trial = state.withColumn("rate", F.greatest(F.col("least_rate"), F.least(F.lit(float(most_copies)), moved)))
        if step % WRITE_EVERY == 0:
            trial = durable(trial)
        new_sums, new_gram = _sums(trial, most_copies)
        if np.linalg.norm((new_sums - want)[moves]) < np.linalg.norm(gap):
            state, sums, gram, length = trial, new_sums, new_gram, min(1.0, 2 * length)
        else:
            length /= 2
    return state.drop("least_rate")


def copies_of(rate: F.Column, doc_id: F.Column) -> F.Column:
    """A rate as whole copies: its floor, and one more with the fraction's probability, drawn from a hash of doc_id."""
    draw = F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most_copies: float = MOST_COPIES, total: float | None = None, keep_clean: bool = False) -> DataFrame:
    """doc_id, tokens, the posterior of each domain, rate and copies of each document in the mix.

    The classifier learns from `labels` (doc_id, quality, toxic) on a bounded sample (hashed_model.TRAIN_DOCS); it reads
    every whole text. A null or empty text has no tokens, so its rate stays 1. Without labels all domains are equally
    likely. Repeated rows count each time; an empty table gives no rows; other columns are ignored.
    """
    return _mix(docs, labels, targets, most_copies, total, keep_clean).drop("__key1", "__key2")


def _mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most_copies: float, total: float | None, keep_clean: bool) -> DataFrame:
    rows = fit_rates(durable(memberships(docs, labels)), targets, most_copies, total, keep_clean)
    return rows.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most_copies: float = 1.0) -> DataFrame:
    """The documents, all columns, as often as the mix takes them; by default none twice. Clean documents
    stay, whatever there is of the other domains, and all documents do without labels; low and toxic ones fill their shares.

    Each row is taken by its own text, one without a doc_id too; equal rows are taken alike. A null or empty text has no
    tokens and stays once."""
    taken = _mix(docs, labels, targets, most_copies, None, True)
    if most_copies > 1:
        taken = durable(taken)
    out = drop_rows(docs, durable(taken.where("copies = 0").select("__key1", "__key2").distinct()))
    if most_copies > 1:
        more = taken.where("copies > 1").groupBy("__key1", "__key2").agg(F.max("copies").alias("__copies"))
        again = docs.withColumns(row_keys(docs)).join(more, ["__key1", "__key2"]).withColumn("__copy", F.explode(F.sequence(F.lit(2), F.col("__copies"))))
        out = out.unionByName(again.select(docs.columns))
    return out
