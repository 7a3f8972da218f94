"""Ordered folds and running sums whose keys may hold any share of the rows.

Rows are laid out by key and order and cut into chunks, so a key is worked on by as many tasks as its size needs: first each
chunk is reduced to what it does to a state (or to its total), then a pass over chunks alone gives the state that each begins
with, then each chunk is worked through on its own.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import durable

#: Rows of a chunk are at most 2 ** CHUNK_BITS.
CHUNK_BITS = 16


def in_chunks(rows: DataFrame, key: list[str], order: list[str], bits: int = CHUNK_BITS) -> DataFrame:
    """rows (durable) with __chunk: runs of at most 2 ** bits rows in the order of key and order; later rows have no smaller chunk."""
    laid = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    return durable(laid.withColumn("__chunk", F.shiftright(F.monotonically_increasing_id(), bits)))


def prefix_sum(rows: DataFrame, key: str, order: list[str], weight: str, name: str = "before", cap: float | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """rows with `name`: the weight (not negative; null counts as none) of the key's rows before it in order. With `cap`, rows
    before which less than that is spent; chunks after a key's budget are not looked into."""
    laid = in_chunks(rows, [key], order, bits)
    totals = laid.groupBy(key, "__chunk").agg(F.sum(weight).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    begun = totals.select(key, "__chunk", F.coalesce(before, F.lit(0)).alias("__begun"))
    if cap is not None:
        begun = begun.where(F.col("__begun") < cap)
    inside = F.sum(weight).over(Window.partitionBy(key, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = laid.join(begun, [key, "__chunk"]).withColumn(name, F.col("__begun") + F.coalesce(inside, F.lit(0))).select(*rows.columns, name)
    return out if cap is None else out.where(F.col(name) < cap)


class Fold:
    """A fold that can be cut into chunks. `columns` are the numeric columns that it reads; a state is None (before the first
    row) or a list of numbers, and a summary a list that json can hold."""

    columns: tuple[str, ...] = ()
    out: dict[str, pa.DataType] = {}

    def summary(self, rows: dict[str, np.ndarray]) -> list:
        raise NotImplementedError

    def through(self, state: list | None, summary: list) -> list:
        raise NotImplementedError

    def inside(self, state: list | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        raise NotImplementedError


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk and key, of batches sorted by them."""
    rest = None
    for b in batches:
        t = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        if not t.num_rows:
            continue
        one, two = (t[c].to_numpy(zero_copy_only=False) for c in ("__chunk", key))
        cuts = [0, *(np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def segmented(rows: DataFrame, key: str, order: list[str], name: str, fold: Fold, bits: int = CHUNK_BITS) -> DataFrame:
    """key, name and fold.out of rows (key, order, name and the columns of the fold); rows without a key go."""
    kinds = dict(rows.dtypes)
    wanted = list(dict.fromkeys([key, *order, name, *fold.columns]))
    laid = in_chunks(rows.select(*wanted).where(F.col(key).isNotNull()), [key], order, bits)
    by = ["__chunk", key]
    arrays = lambda t: {c: t[c].to_numpy(zero_copy_only=False) for c in fold.columns}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, key):
            yield pa.RecordBatch.from_arrays([t["__chunk"][:1], t[key][:1], pa.array([json.dumps(fold.summary(arrays(t)))])], ["__chunk", key, "summary"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for k, summary in zip(b[key].to_pylist(), b["summary"].to_pylist()):
                if k != now:
                    now, state = k, None
                out.append(None if state is None else json.dumps(state))
                state = fold.through(state, json.loads(summary))
            yield pa.RecordBatch.from_arrays([b["__chunk"], b[key], pa.array(out, pa.string())], ["__chunk", key, "state"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, key):
            state = t["state"][0].as_py()
            made = fold.inside(None if state is None else json.loads(state), arrays(t))
            yield pa.RecordBatch.from_arrays([t[key], t[name], *[pa.array(made[c], k) for c, k in fold.out.items()]], [key, name, *fold.out])

    sorted_ = laid.repartition(*by).sortWithinPartitions(*by, *order)
    summaries = durable(sorted_.mapInArrow(reduce, f"__chunk long, {key} {kinds[key]}, summary string"))
    states = summaries.repartition(key).sortWithinPartitions(key, "__chunk").mapInArrow(walk, f"__chunk long, {key} {kinds[key]}, state string")
    met = laid.hint("shuffle_hash").join(states, by).sortWithinPartitions(*by, *order)
    names = {pa.bool_(): "boolean", pa.float64(): "double", pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
    schema = f"{key} {kinds[key]}, {name} {kinds[name]}, " + ", ".join(f"{c} {names[k]}" for c, k in fold.out.items())
    return met.mapInArrow(work, schema)


class Accept(Fold):
    """`accepted`: the first row, and each that comes `gap` or more after the last accepted one (times `at`, whole numbers).

    Where a chunk leaves off depends only on its first accepted row, which comes within a gap of its first row; rows from which
    the same row is reached are one step of the summary."""

    columns = ("at",)
    out = {"accepted": pa.bool_()}

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def _next(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(at, at + self.gap), np.arange(1, len(at) + 1))

    def summary(self, rows: dict[str, np.ndarray]) -> list:
        at = rows["at"].astype(np.int64)
        after, last = self._next(at).tolist(), at.tolist()
        for i in range(len(last) - 1, -1, -1):
            if after[i] < len(last):
                last[i] = last[after[i]]
        till: list[int] = []
        left: list[int] = []
        for t, x in zip(at[: after[0] + 1].tolist(), last):
            if left and left[-1] == x:
                till[-1] = t
            else:
                till.append(t)
                left.append(x)
        return [till, left]

    def through(self, state: list | None, summary: list) -> list:
        till, left = summary
        i = 0 if state is None else bisect_left(till, state[0] + self.gap)
        return [left[i]] if i < len(till) else state

    def inside(self, state: list | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at = rows["at"].astype(np.int64)
        taken = np.zeros(len(at), bool)
        i, after = 0 if state is None else int(np.searchsorted(at, state[0] + self.gap)), self._next(at).tolist()
        while i < len(at):
            taken[i] = True
            i = after[i]
        return {"accepted": taken}


class Smooth(Fold):
    """`smooth`: cur + (value - cur)(1 - exp(-max(0, dt) response)), from the first value on. After its first row, a chunk maps
    what it begins with to what it ends with by a factor and a sum."""

    columns = ("t", "value")
    out = {"smooth": pa.float64()}

    def __init__(self, response: float) -> None:
        self.response = response

    def _shares(self, t: np.ndarray) -> list[float]:
        return (1 - np.exp(-np.maximum(0.0, np.diff(t)) * self.response)).tolist()

    def summary(self, rows: dict[str, np.ndarray]) -> list:
        t, value = rows["t"], rows["value"].tolist()
        factor, total = 1.0, 0.0
        for v, share in zip(value[1:], self._shares(t)):
            factor, total = factor * (1 - share), total + (v - total) * share
        return [float(t[0]), value[0], float(t[-1]), factor, total]

    def _first(self, state: list | None, t: float, value: float) -> float:
        if state is None:
            return value
        return state[1] + (value - state[1]) * float(1 - np.exp(-max(0.0, t - state[0]) * self.response))

    def through(self, state: list | None, summary: list) -> list:
        t, value, end, factor, total = summary
        return [end, factor * self._first(state, t, value) + total]

    def inside(self, state: list | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        t, value = rows["t"], rows["value"].tolist()
        out = [self._first(state, float(t[0]), value[0])]
        for v, share in zip(value[1:], self._shares(t)):
            out.append(out[-1] + (v - out[-1]) * share)
        return {"smooth": np.array(out)}


class Drive(Fold):
    """A drive along checkpoints (columns rx, rz: one array for each key): ready until the vehicle moves faster than 1.2, then
    running from checkpoint to checkpoint within 9 of each, then finished. A chunk maps each checkpoint that the drive may have
    next, and ready, to the one that it leaves with and the time at which the clock stops."""

    columns = ("at", "x", "z", "speed", "rx", "rz")
    out = {"status": pa.string(), "elapsed": pa.float64(), "checkpoint": pa.int32()}
    REACH, MOVING = 9.0, 1.2

    def _hits(self, rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        """For each checkpoint the rows that are within reach of it."""
        x, z = rows["x"], rows["z"]
        return [np.flatnonzero(((x - cx) ** 2 + (z - cz) ** 2) ** 0.5 <= self.REACH) for cx, cz in zip(rows["rx"][0], rows["rz"][0])]

    def _steps(self, hits: list[np.ndarray], nxt: int, row: int) -> list[int]:
        """The rows at which a drive that runs from `row` on with the checkpoint `nxt` ahead passes this and the following ones."""
        out: list[int] = []
        while nxt < len(hits):
            k = int(np.searchsorted(hits[nxt], row))
            if k == len(hits[nxt]):
                break
            out.append(int(hits[nxt][k]))
            row, nxt = out[-1] + 1, nxt + 1
        return out

    def _begin(self, rows: dict[str, np.ndarray]) -> int | None:
        moving = np.flatnonzero(np.abs(rows["speed"]) > self.MOVING)
        return int(moving[0]) if len(moving) else None

    def summary(self, rows: dict[str, np.ndarray]) -> list:
        at, hits, begin = rows["at"], self._hits(rows), self._begin(rows)
        ways = []
        for nxt in range(1, len(hits)):
            passed = self._steps(hits, nxt, 0)
            end = nxt + len(passed)
            ways.append([end, float(at[passed[-1] if end == len(hits) else -1])])
        ready = None
        if begin is not None:
            passed = self._steps(hits, 1, begin)
            end = 1 + len(passed)
            ready = [float(at[begin - 1]) if begin else None, end, float(at[passed[-1] if end == len(hits) else -1])]
        return [len(hits), float(at[0]), float(at[-1]), ready, ways]

    # a state: [next checkpoint (0: ready), seconds run, time of the last row, number of checkpoints]

    def through(self, state: list | None, summary: list) -> list:
        m, first, last, ready, ways = summary
        nxt, elapsed, before = (0, 0.0, first) if state is None else state[:3]
        if nxt == 0 and ready:
            since, nxt, till = ready
            elapsed = till - (before if since is None else since)
        elif 0 < nxt < m:
            nxt, till = ways[nxt - 1]
            elapsed += till - before
        return [nxt, elapsed, last]

    def inside(self, state: list | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at, hits, n = rows["at"], self._hits(rows), len(rows["at"])
        nxt, elapsed, before = (0, 0.0, float(at[0])) if state is None else state
        status, m = np.full(n, "ready", object), len(hits)
        seconds, ahead = np.full(n, elapsed), np.full(n, max(nxt, 1))
        begin = 0 if nxt else self._begin(rows)
        if nxt >= m:
            status[:] = "finished"
        elif begin is not None:
            passed = self._steps(hits, max(nxt, 1), begin)
            end = passed[-1] if max(nxt, 1) + len(passed) == m else n - 1
            status[begin:] = "running"
            seconds[begin : end + 1] = elapsed + at[begin : end + 1] - (float(at[begin - 1]) if begin else before)
            seconds[end + 1 :] = seconds[end]
            for row in passed:
                ahead[row:] += 1
            if max(nxt, 1) + len(passed) == m:
                status[end:] = "finished"
        return {"status": status, "elapsed": seconds, "checkpoint": np.minimum(ahead, m - 1).astype(np.int32)}


class Changes(Fold):
    """`changed`: the first row, and each whose `signature` differs from that of the row before."""

    columns = ("signature",)
    out = {"changed": pa.bool_()}

    def summary(self, rows: dict[str, np.ndarray]) -> list:
        return [rows["signature"][-1]]

    def through(self, state: list | None, summary: list) -> list:
        return summary

    def inside(self, state: list | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        sign = rows["signature"].astype(object)
        return {"changed": np.concatenate([[state is None or state[0] != sign[0]], sign[1:] != sign[:-1]]).astype(bool)}
