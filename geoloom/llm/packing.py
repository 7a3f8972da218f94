"""Best-fit packing of token pieces by exact complements (operator 12).

Texts become pieces of at most `capacity` tokens, and only how many pieces there are of each length goes to the driver: at most
`capacity` numbers. On them the packing is planned: a length's gap is looked up among the lengths, the sums of two and of three
lengths; what fills it exactly is consumed as often as the counts allow. What is left goes best-fit, longest first, into the
tightest gaps. A step of the plan names a run of equal sequences and a run of equal pieces, so the plan grows with the lengths,
not with the pieces. Pieces are numbered within their length by tasks, and each finds its step by its number.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_alphabet
from .common import arrow_schema, byte_texts, chunks, durable, map_batches, to_batch, whole_texts

#: Words that a worker remembers the ids of, then it starts anew; longer ones than LONGEST bytes are not kept.
MOST_WORDS, LONGEST, STEP = 800_000, 64, 4096
CAPACITY, END = 4096, 1
#: Marks that end a word as a piece of their own; the last code point of the Latin letters.
MARKS, LATIN = ".,;:!?", "\u00ff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The tokenizer of a file, word by word: it drops white space and no token spans any, so a text's ids are those of what
    stands between ASCII spaces, and a word met before is not encoded again."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.letters = str.maketrans({b: c for c, b in byte_alphabet().items()})
        self.marks = {c: array("I", [t.id for t in self.tokenizer.model.tokenize(c)]).tobytes() for c in MARKS}

    def _word(self, word: str) -> bytes | None:
        """The ids of Latin letters with at most one mark after them, which its model alone gives: such letters are one piece,
        composed already, and lower-cased one by one. None for other words."""
        end = self.marks.get(word[-1], b"")
        letters = (word[:-1] if end else word).lower()
        if not letters.isalpha():
            return None
        if not letters.isascii():
            if max(letters) > LATIN:
                return None
            letters = letters.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes() + end

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        words = [t.split() for t in texts]
        new, others = set().union(*words).difference(self.known), []
        for w in new:
            if (ids := self._word(w.decode())) is None:
                others.append(w)
            else:
                self.known[w] = ids
        for i in range(0, len(others), STEP):
            some = others[i : i + STEP]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's ids and an end mark, cut into pieces of at most `capacity`; and
    task, nth: the piece's number among those of its length in its task."""
    path = path or default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    arrow = arrow_schema(docs, schema)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            raw, ids = byte_texts(b["text"]), b["doc_id"].to_pylist()
            for a, z in chunks(raw):
                for doc, packed in zip(ids[a:z], encoder(path).encode(raw[a:z])):
                    packed += end
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(part), task, seen[n]))
                        seen[n] += 1
            yield to_batch(dict(zip(arrow.names, zip(*rows) if rows else ((),) * 7)), arrow)

    return whole_texts(docs).mapInArrow(run, schema)


class Plan:
    """The packing of `counts` pieces by length into sequences of `capacity`: steps (length, first, count, each, sequence,
    offset): of the pieces of a length those from number `first` on go `each` to a sequence, from `sequence` on, at `offset`. Before the
    best fit, whole sequences are made of a length and up to `most` others (none: best fit alone)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, most: int = 3) -> None:
        self.capacity, self.left, self.used = capacity, Counter(counts), Counter()
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        self.sequences, self.most = 0, most
        self.lengths = sorted((n for n in counts if counts[n]), reverse=True)
        self.sums: dict[int, tuple[list[int], int]] = {}
        self.there, self.paired = np.array(self.lengths, np.int64), np.ones(capacity + 1, bool)
        self.spent: set[int] = set()
        for k in range(most + 1):
            for n in self.lengths:
                self._fill_exactly(n, k)
        self._best_fit()

    # the index of sums: which two lengths make a sum, larger one first, with how far the list is used up

    def _pair(self, total: int) -> tuple[int, int] | None:
        if total not in self.sums:
            self.sums[total] = ([n for n in self.there[(2 * self.there >= total) & (self.there < total)].tolist() if self.left.get(total - n)], 0)
        (firsts, at), left = self.sums[total], self.left
        while at < len(firsts) and not (left[n := firsts[at]] and (left[total - n] > (2 * n == total))):
            at += 1
        self.sums[total] = (firsts, at)
        self.paired[total] = at < len(firsts)
        return (firsts[at], total - firsts[at]) if at < len(firsts) else None

    def _often(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(self.left[n] // k for n, k in Counter(lengths).items())

    def _filling(self, gap: int, anchor: tuple[int, ...] = (), most: int = 3) -> tuple[int, ...] | None:
        """One, two or three lengths that make up the gap and are there beside the anchor."""
        if gap in self.spent or not self.most:
            return None
        if self._often((*anchor, gap)):
            return (gap,)
        if most > 1 and (two := self._pair(gap)) and self._often((*anchor, *two)):
            return two
        if most < 3:
            return None
        some = self.there[self.there < gap]
        for n in some[self.paired[gap - some]].tolist():
            if self.left[n] and (two := self._pair(gap - n)) and self._often((*anchor, n, *two)):
                return (n, *two)
        if not anchor:
            self.spent.add(gap)  # counts only fall, so nothing will fill it later
        return None

    def _take(self, n: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.steps.append((n, self.used[n], count, each, sequence, offset))
        self.used[n] += count
        self.left[n] -= count
        if not self.left[n]:
            self.there = self.there[self.there != n]

    def _put(self, lengths: tuple[int, ...], sequences: int, first: int, offset: int) -> None:
        for n in lengths:
            self._take(n, sequences, 1, first, offset)
            offset += n

    def _fill_exactly(self, n: int, most: int) -> None:
        while self.left[n]:
            gap = self.capacity - n
            filling = self._filling(gap, (n,), most) if gap and most else None if gap else ()
            if filling is None:
                return
            k = self._often((n, *filling))
            self._put((n, *filling), k, self.sequences, 0)
            self.sequences += k

    def _best_fit(self) -> None:
        """Lengths descend, so a gap under the shortest left is never asked again. Open runs of sequences stand by their gap."""
        open_: dict[int, list[tuple[int, int]]] = {}
        gaps: list[int] = []

        def add(gap: int, first: int, k: int) -> None:
            while k and gap and (filling := self._filling(gap)):
                some = min(k, self._often(filling))
                self._put(filling, some, first, self.capacity - gap)
                first, k = first + some, k - some
            if k and gap:
                if gap not in open_:
                    open_[gap] = []
                    gaps.insert(bisect_left(gaps, gap), gap)
                open_[gap].append((first, k))

        for n in self.lengths:
            while self.left[n]:
                at = bisect_left(gaps, n)
                if at == len(gaps):
                    each = min(self.capacity // n, self.left[n])
                    first, k, gap = self.sequences, self.left[n] // each, self.capacity
                    self.sequences += k
                else:
                    gap = gaps[at]
                    first, k = open_[gap].pop()
                    if not open_[gap]:
                        del open_[gap], gaps[at]
                    each = min(gap // n, self.left[n])
                    if (some := min(k, self.left[n] // each)) < k:
                        open_.setdefault(gap, []).append((first + some, k - some))
                        if len(open_[gap]) == 1:
                            gaps.insert(bisect_left(gaps, gap), gap)
                    k = some
                self._take(n, k * each, each, first, self.capacity - gap)
                add(gap - each * n, first, k)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan of fewest sequences: where long pieces prevail, short ones are better kept for their gaps than used up early."""
    return min((Plan(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda p: p.sequences)


def best_fit(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (length, task, nth and more; durable) with sequence_id and offset; task and nth go."""
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = durable(by_task.withColumn("before", before))
    counts = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = np.array(sorted(plan(counts, capacity).steps) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    shared = cut.sparkSession.sparkContext.broadcast(steps)
    names = [c for c in cut.columns if c not in ("task", "nth")]
    kinds = dict(cut.dtypes)

    def run(b: pa.RecordBatch) -> dict:
        length, first, _, each, sequence, offset = shared.value.T
        n, k = b["length"].to_numpy(), b["number"].to_numpy()
        # steps are sorted by length and first number: the last one at or before the piece's
        start = np.searchsorted(length, n)
        order = np.lexsort((k, n))
        at = np.empty(len(n), np.int64)
        for i in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
            end = np.searchsorted(length, n[i[0]], "right")
            at[i] = start[i[0]] + np.searchsorted(first[start[i[0]] : end], k[i], "right") - 1
        nth = k - first[at]
        return {c: b[c] for c in names} | {"sequence_id": sequence[at] + nth // each[at], "offset": offset[at] + nth % each[at] * n}

    met = cut.hint("merge").join(numbers.select("task", "length", "before"), ["task", "length"]).select(*names, (F.col("before") + F.col("nth")).alias("number"))
    return map_batches(met, run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "sequence_id long, offset long"]))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All texts packed: per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end mark alone; rows that repeat are packed as often as they come, and a null doc_id stays
    null. Pieces of equal length are interchangeable: which goes where follows their task and order. Empty tables give an
    empty result.
    """
    return best_fit(durable(pieces(docs, path, capacity)), capacity)
