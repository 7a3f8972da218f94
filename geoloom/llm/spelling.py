"""Spelling variants: pairs of words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and the
acceptor again (operator 13).

The acceptor is split at its initial states: a prefix with more than `most` words below it is an inner state that is split
further, any other is the initial state of a partition. A pair's words are equal up to their edit. If a partition's state is at or
before it, both words are in that partition: its minimised acceptor is built there, and the composition lists the pairs. If the
edit is at a split state, the words are equal after it: both are dealt out by what they spell without the edited letter. So no
task holds more than one partition's words, or more than an alphabet of words for one spelling, and each pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, byte_texts, durable, to_batch, whole_texts

LEAST = 7
#: The runs that can become a word: at least LEAST letters.
RUN = re.compile("[A-Za-zÀ-ÿ]{7,}")
LOWER = {c: c + 32 for c in range(65, 91)}
#: One in LOST of a document's runs loses a letter.
LOST = 31
#: Words that a task counts before it passes them on; words below one initial state; letters of prefixes counted in one pass.
HELD, MOST, REACH = 400_000, 8192, 8
#: Longer words than this would cost their length squared; they meet by fingerprints of what they are without a letter.
LONG, BASE, PRIME = 128, 1_000_003, 2**127 - 1


def word_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """word, n: the runs of all texts, each with its document's lost letters, that come `least` times or more."""
    schema = "word string, n long"
    arrow = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), byte_texts(b["text"])):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, k in Counter(RUN.findall(text.decode())).items():
                    word = word.lower() if word.isascii() else word.translate(LOWER)
                    h = zlib.crc32(word.encode(), begun)
                    if h % LOST == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST:
                            continue
                    found[word] += k
                if len(found) > HELD:
                    yield to_batch({"word": list(found), "n": list(found.values())}, arrow)
                    found.clear()
        yield to_batch({"word": list(found), "n": list(found.values())}, arrow)

    return whole_texts(docs).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def initial_states(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, depth: how long the prefix is whose state begins the word's partition; every shorter prefix of the word has
    more than `most` words (durable)."""
    done, left, at = None, words.select("word", "n", F.lit(0).alias("depth")), 0
    while True:
        lengths = F.sequence(F.lit(at), F.least(F.lit(at + REACH - 1), F.length("word")))
        counted = left.select(F.explode(F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("below"))
        split = durable(counted.where(F.col("below") > most).select("prefix"))
        deep = split.agg(F.max(F.length("prefix"))).first()[0]  # one number
        if deep is None:
            return durable(left) if done is None else durable(done.unionByName(left))
        # prefixes of split ones are split, so a word's depth is the number of its split prefixes
        pieces = left.select("word", "n", "depth", F.explode(F.sequence(F.lit(at), F.least(F.lit(deep), F.length("word")))).alias("k"))
        met = pieces.withColumn("prefix", F.substring("word", F.lit(1), F.col("k"))).join(split, "prefix", "left_semi")
        depth = durable(left.select("word", "n", "depth", F.lit(0).alias("more")).unionByName(met.select("word", "n", "depth", F.lit(1).alias("more"))).groupBy("word", "n", "depth").agg(F.sum("more").cast("int").alias("more")))
        depth = depth.select("word", "n", (F.col("depth") + F.col("more")).alias("depth"))
        if deep < at + REACH - 1:
            return durable(depth) if done is None else durable(done.unionByName(depth))
        ended = depth.where(F.col("depth") < at + REACH)
        done = ended if done is None else done.unionByName(ended)
        left, at = depth.where(F.col("depth") >= at + REACH), at + REACH


class Acceptor:
    """The minimal acceptor of sorted words: states are numbers; next[q] has the transitions of q, ends[q] if words end there."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = []
        self.ends: list[bool] = []
        known: dict[tuple, int] = {}

        def state(final: bool, out: dict[str, int]) -> int:
            key = (final, *out.items())
            if (q := known.get(key)) is None:
                q = known[key] = len(self.next)
                self.next.append(out)
                self.ends.append(final)
            return q

        # the path of the last word: (final, transitions) of each state, the state below it still open
        path: list[list] = [[False, {}]]
        last = ""
        for w in [*words, ""]:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            for i in range(len(last), same, -1):
                final, out = path.pop()
                path[-1][1][last[i - 1]] = state(final, out)
            path += [[False, {}] for _ in w[same:]]
            path[-1][0] = path[-1][0] or w != "" or (w == last == "" and bool(words))
            last = w
        self.start = state(*path[0])
        self.lengths = [0] * len(self.next)
        for q, out in enumerate(self.next):  # children come before their parents
            self.lengths[q] = self.ends[q] | sum_or(self.lengths[r] << 1 for r in out.values())


def sum_or(masks) -> int:
    all_ = 0
    for m in masks:
        all_ |= m
    return all_


class Composition:
    """The acceptor, the transducer of one replaced or deleted letter, and the acceptor again. Before the edit both sides are in
    one state; after it, they read on together. What a pair of states can both read is worked out once."""

    def __init__(self, words: list[str]) -> None:
        self.a = Acceptor(words)
        self.both: dict[tuple[int, int], list[str]] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}

    def common(self, q: int, r: int) -> list[str]:
        """What q and r both accept."""
        if not self.a.lengths[q] & self.a.lengths[r]:
            return []
        key = (q, r) if q < r else (r, q)
        if (found := self.both.get(key)) is None:
            one, two = self.a.next[q], self.a.next[r]
            found = [""] if self.a.ends[q] and self.a.ends[r] else []
            for c in one.keys() & two.keys():
                found += [c + t for t in self.common(one[c], two[c])]
            self.both[key] = found
        return found

    def edits_at(self, q: int) -> list[tuple[str, str]]:
        """The pairs of rests that q accepts and whose first letters are the edit. Of a deleted run's letters the last counts."""
        if (found := self.edits.get(q)) is None:
            out, found = list(self.a.next[q].items()), []
            for i, (x, r) in enumerate(out):
                for y, s in out[i + 1 :]:
                    found += [(x + t, y + t) for t in self.common(r, s)]
                found += [(x + t, t) for t in self.common(r, q) if t[:1] != x]
            self.edits[q] = found
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        stack = [(self.a.start, "")]
        while stack:
            q, prefix = stack.pop()
            for u, v in self.edits_at(q):
                yield prefix + u, prefix + v
            stack += [(r, prefix + c) for c, r in self.a.next[q].items()]


NEAR = "word string, n long, n_near long, best_n long, best string"


class Near:
    """Of each word how many are near it, and the most frequent of them (ties: the smallest)."""

    def __init__(self) -> None:
        self.found: dict[str, list] = {}

    def add(self, u: str, n: int, v: str, m: int) -> None:
        for a, k, b, j in ((u, n, v, m), (v, m, u, n)):
            if (x := self.found.get(a)) is None:
                self.found[a] = [k, 1, j, b]
            else:
                x[1] += 1
                if j > x[2] or (j == x[2] and b < x[3]):
                    x[2:] = j, b

    def batch(self, arrow: pa.Schema) -> pa.RecordBatch:
        columns = zip(*((w, *x) for w, x in self.found.items())) if self.found else ((),) * 5
        self.found = {}
        return to_batch(dict(zip(arrow.names, columns)), arrow)


def runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of each key, at least `least`, of batches sorted by it."""
    rest = None
    for b in batches:
        t = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        keys = t[key].to_numpy(zero_copy_only=False).astype(object)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:]):
            if z - a >= least:
                yield t.slice(a, z - a)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows >= least:
        yield rest


def near_in_partitions(placed: DataFrame) -> DataFrame:
    """The near pairs whose edit is at or after the initial state, by composition in each partition."""
    arrow = arrow_schema(placed, NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "state", 2):
            near, prefix, counts = Near(), t["state"][0].as_py(), dict(zip(t["word"].to_pylist(), t["n"].to_pylist()))
            for u, v in Composition([w[len(prefix) :] for w in counts]).pairs():
                u, v = prefix + u, prefix + v
                near.add(u, counts[u], v, counts[v])
            yield near.batch(arrow)

    keyed = placed.select(F.substring("word", F.lit(1), F.col("depth")).alias("state"), "word", "n")
    return keyed.repartition("state").sortWithinPartitions("state", "word").mapInArrow(run, NEAR)


def near_before_partitions(placed: DataFrame) -> DataFrame:
    """The near pairs whose edit is at a split state, by what the words spell without the edited letter."""
    arrow = arrow_schema(placed, NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Near()
        for t in runs(batches, "spelt", 2):
            rows = list(zip(*(t[c].to_pylist() for c in ("spelt", "at", "word", "n"))))
            for i, (spelt, at, u, n) in enumerate(rows):
                for _, k, v, m in rows[i + 1 :]:
                    # at -1: the whole word, which another one becomes by losing a letter; of a run of letters, the last
                    if (at == k and at >= 0) or (at < 0 <= k and v[k] != spelt[k : k + 1]) or (k < 0 <= at and u[at] != spelt[at : at + 1]):
                        near.add(u, n, v, m)
            if len(near.found) > HELD:
                yield near.batch(arrow)
        yield near.batch(arrow)

    places = F.sequence(F.lit(-1), F.least(F.col("depth"), F.length("word")) - 1)
    dealt = placed.where("depth > 0").select("word", "n", F.explode(places).alias("at"))
    spelt = F.when(F.col("at") < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("at")), F.expr("substring(word, at + 2)")))
    return dealt.select(spelt.alias("spelt"), "at", "word", "n").repartition("spelt").sortWithinPartitions("spelt").mapInArrow(run, NEAR)


def without_each(word: str) -> tuple[int, Iterator[int]]:
    """The 127-bit fingerprint of a word, and that of the word without its i-th letter for each i; in linear time."""
    before, after, power = [0], [0], [1]
    for a, z in zip(word, reversed(word)):
        before.append((before[-1] * BASE + ord(a)) % PRIME)
        after.append((after[-1] + ord(z) * power[-1]) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    n = len(word)
    return before[n], ((before[i] * power[n - 1 - i] + after[n - 1 - i]) % PRIME for i in range(n))


def near_long(words: DataFrame) -> DataFrame:
    """The near pairs with a word of more than LONG letters. Words are named by their fingerprints, so a row is as long for any
    word; replaced letters meet by place and rest, lost ones (of a run the last) by the rest and the whole other word."""
    named = arrow_schema(words, "name string, word string, n long")
    schema = "spelt string, whole boolean, name string"
    arrow = arrow_schema(words, schema)
    text = words.where(F.length("word") >= LONG)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield to_batch({"name": [f"{without_each(w)[0]:x}" for w in b["word"].to_pylist()], "word": b["word"], "n": b["n"]}, named)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in b["word"].to_pylist():
                whole, rests = without_each(w)
                rows = [(f"{whole:x}", True)]
                if len(w) > LONG:
                    for i, h in enumerate(rests):
                        rows += [(f"{h:x}:{i}", False), *([(f"{h:x}", False)] if w[i] != w[i + 1 : i + 2] else [])]
                spelt, is_whole = zip(*rows)
                yield to_batch({"spelt": spelt, "whole": is_whole, "name": [f"{whole:x}"] * len(rows)}, arrow)

    names = durable(text.select("word", "n").mapInArrow(name, "name string, word string, n long"))
    rows = durable(text.select("word").mapInArrow(spell, schema))
    placed, rest = rows.where("not whole and instr(spelt, ':') > 0").select("spelt", "name"), rows.where("not whole and instr(spelt, ':') = 0").select("spelt", "name")
    whole = rows.where("whole").select("spelt", F.col("name").alias("other"))
    replaced = placed.join(placed.select("spelt", F.col("name").alias("other")), "spelt").where("name < other")
    pairs = replaced.unionByName(rest.join(whole, "spelt")).select("name", "other")
    both = pairs.unionByName(pairs.select(F.col("other").alias("name"), F.col("name").alias("other")))
    others = names.select(F.col("name").alias("other"), F.col("word").alias("best"), F.col("n").alias("best_n"))
    return both.join(names, "name").join(others, "other").select("word", "n", F.lit(1).cast("long").alias("n_near"), "best_n", "best")


def variants(words: DataFrame, times: int = 10, most: int = MOST) -> DataFrame:
    """word, form, n, n_near, form_n of words (word, n; durable): the form is the most frequent word one edit away, if it is
    `times` as frequent."""
    placed = initial_states(words.where(F.length("word") <= LONG), most)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    found = none.unionByName(near_in_partitions(placed)).unionByName(near_before_partitions(placed)).unionByName(near_long(words)).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    often = -F.col("b.less") >= times * F.col("n")
    return found.select("word", F.when(often, F.col("b.best")).alias("form"), "n", "n_near", F.when(often, -F.col("b.less")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """variants() (durable) with root: the last word that the forms lead to. A form is `times` as frequent as its word, so there
    are no rings, and jumps double in length each round: five rounds do for any counts."""
    jumps = durable(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = durable(jumps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved, jumps = far.where("moved").limit(1).count(), far.select("word", "root")
        if not moved:
            break
    return found.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 2, times: int = 10, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of at least 7 letters that the texts hold `least` times.

    A null text has no words; a null doc_id is spelt as nothing before the colon. Rows that repeat count again. Ties of
    frequency go to the smaller word in code points. Empty tables give an empty result. `most` only sets the size of
    partitions, with the same rows for any value.
    """
    return with_roots(durable(variants(durable(word_counts(docs, least)), times, most)))
