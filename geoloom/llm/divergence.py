"""How far the sources of a language diverge in their words, by bitmaps of terms per count (operator 11).

Terms are counted in tasks; a language keeps those in enough of its documents. Kept terms are laid out by falling count, 64 to a
word; of each (group, count) a bitset says which of the word's terms the group has that often. AND and popcount of two groups'
bitsets give how many terms have these two counts; a pair's value is the sum over these joint cells. Cells with a zero follow by
complement: the terms of a count less those that the other group has too. So absent terms are never written or met.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, byte_texts, durable, to_batch

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Runs of letters and of bytes over 127: what the code points 128 and up are made of.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Counted terms that a task holds before it passes them on.
HELD = 300_000
#: Groups of a language that one task compares; more are dealt to blocks of about this size, and pairs of blocks meet.
BLOCK = 64
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it), one row for each term of a group that a task held."""
    texts = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    schema = "lang string, source string, term string, n long, d long"
    arrow = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for text, lang, source in zip(byte_texts(b["text"]), b["lang"].to_pylist(), b["source"].to_pylist()):
                n, d = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(d)
                terms = TERM.findall(text.translate(LOWER))
                n.update(terms)
                d.update(set(terms))
                size += len(d) - before
                if size > HELD:
                    yield from out(found)
                    found, size = {}, 0
        yield from out(found)

    def out(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in found.items():
            if d:
                terms = list(d)
                yield to_batch({"lang": [lang] * len(terms), "source": [source] * len(terms), "term": pa.array(terms, pa.binary()), "n": [n[t] for t in terms], "d": list(d.values())}, arrow)

    return texts.mapInArrow(run, schema)


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, source, term, n of the terms in at least `least_docs` documents of the language, with total, n over all sources."""
    term = Window.partitionBy("lang", "term")
    summed = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return summed.withColumns({"total": F.sum("n").over(term), "docs": F.sum("d").over(term)}).where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, in units of 1 / SCALE, add-one smoothed; exact for any count."""
    ones = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", ones, (total + terms).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def bitsets(kept: DataFrame) -> DataFrame:
    """lang, word, source, n, bits: which of the word's 64 terms the source has exactly n times."""
    schema = "lang string, word long, source string, n long, bits long"
    arrow = arrow_schema(kept, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        word = TaskContext.get().partitionId() << 40
        now, last, at, bits = None, None, 0, {}
        for b in batches:
            out: list[tuple] = []
            for lang, source, term, n in zip(*(b[c].to_pylist() for c in ("lang", "source", "term", "n"))):
                if (lang, term) != last:
                    last, at = (lang, term), at + 1
                    if lang != now or at == 64:
                        out += [(now, word, s, k, x) for (s, k), x in bits.items()]
                        now, at, bits, word = lang, 0, {}, word + 1
                bits[source, n] = bits.get((source, n), 0) | 1 << at
            yield packed(out)
        yield packed([(now, word, s, k, x) for (s, k), x in bits.items()])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        lang, word, source, n, x = zip(*rows) if rows else ((),) * 5
        return to_batch({"lang": lang, "word": word, "source": source, "n": n, "bits": np.array(x, np.uint64).view(np.int64)}, arrow)

    laid = kept.repartitionByRange(F.desc("total"), "lang", "term").sortWithinPartitions("lang", F.desc("total"), "term")
    return laid.select("lang", "source", "term", "n").mapInArrow(run, schema)


def joint_sums(levels: DataFrame) -> DataFrame:
    """lang, source, item, part of levels (lang, word, block, cell, source, p, p0, bits): over the terms that both groups
    have, f of their counts less what the zero cells count for them. Rows of a (lang, cell, word) are met in one task: at most
    64 terms of two blocks of groups."""
    schema = "lang string, source string, item string, part long"
    arrow = arrow_schema(levels, schema)

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def meet(lang: str, t: pa.RecordBatch, sums: dict) -> None:
        names, group = np.unique(t["source"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        p, p0, block = t["p"].to_numpy(), t["p0"].to_numpy(), t["block"].to_numpy()
        bits = t["bits"].to_numpy().view(np.uint64)
        one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        # a word with many entries is met some rows at a time, so that the table of ANDs stays small
        total = np.zeros((len(names), len(names)), np.int64)
        for k in range(0, len(one), step := max(1, (1 << 20) // len(two))):
            mine = one[k : k + step]
            cells = np.bitwise_count(bits[mine][:, None] & bits[two][None, :])
            i, j = np.nonzero(cells)
            n, i, j = cells[i, j].astype(np.int64), mine[i], two[j]
            i, j, n = (x[group[i] != group[j]] for x in (i, j, n))
            for a, b in ((i, j), (j, i)) if block[0] != block[-1] or block.min() != block.max() else ((i, j),):
                value = n * (f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
                np.add.at(total, (group[a], group[b]), value)
        for a, b in zip(*np.nonzero(total)):
            sums[lang, names[a], names[b]] = sums.get((lang, names[a], names[b]), 0) + int(total[a, b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, int] = {}
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
            word, cell, lang = t["word"].to_numpy(), t["cell"].to_numpy(), t["lang"].to_numpy().astype(object)
            cuts = np.flatnonzero((word[1:] != word[:-1]) | (cell[1:] != cell[:-1]) | (lang[1:] != lang[:-1])) + 1
            whole = t.to_batches()[0]
            for a, z in zip([0, *cuts[:-1]], cuts):
                meet(lang[a], whole.slice(a, z - a), sums)
            rest = whole.slice(cuts[-1] if len(cuts) else 0)
            if len(sums) > HELD:
                yield out(sums)
                sums = {}
        if rest is not None and rest.num_rows:
            meet(rest["lang"][0].as_py(), rest, sums)
        yield out(sums)

    def out(sums: dict) -> pa.RecordBatch:
        lang, source, item = zip(*sums) if sums else ((),) * 3
        return to_batch({"lang": lang, "source": source, "item": item, "part": list(sums.values())}, arrow)

    return levels.select("lang", "cell", "word", "block", "source", "p", "p0", "bits").repartition("lang", "cell", "word").sortWithinPartitions("lang", "cell", "word").mapInArrow(run, schema)


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language, with the sum over the kept terms
    of f = (p - q)^2 / q of their smoothed shares; part `term`: the `top` terms that the source has oftener than its language.

    Null text, lang or source count as ''. A row is a document, so repeated rows count again. A group without terms has pairs
    and no terms; a language of one source has no pairs; empty tables give an empty result. Ties rank by item. Values are
    exact: shares are integers and counts take any size.
    """
    kept = durable(kept_terms(term_counts(docs), least_docs))
    groups = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    tokens = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_tokens"))
    langs = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("lang_tokens"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    blocks = F.ceil(F.col("n_groups") / BLOCK).cast("int")
    stats = groups.join(tokens, ["lang", "source"], "left").join(sizes, "lang").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_tokens", "n_terms", "lang_tokens")],
        blocks.alias("blocks"), F.pmod(F.hash("source"), blocks).alias("block"),
    )
    zero = F.when(F.col("n_terms") > 0, share(F.lit(0), F.col("n_tokens"), F.greatest("n_terms", F.lit(1))))
    stats = durable(stats.withColumn("p0", zero))
    return pairs(kept, stats).unionByName(terms(kept, stats, top))


def pairs(kept: DataFrame, stats: DataFrame) -> DataFrame:
    few = stats.select("lang", "source", "n_tokens", "n_terms", "blocks", "block", "p0")
    # level rows are few words' bits a group, not documents; sources stand in them by name
    levels = durable(bitsets(kept).join(few, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_tokens"), F.col("n_terms"))).select("lang", "word", "source", "n", "bits", "p", "p0", "block", "blocks"))
    spread = levels.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    joint = joint_sums(spread.withColumn("cell", low.cast("long") * F.col("blocks") + high)).groupBy("lang", "source", "item").agg(F.sum("part").alias("joint"))
    # complement: what a group's counts make with the other's zeros, and the zeros of both
    sizes = levels.groupBy("lang", "source", "p").agg(F.sum(F.bit_count("bits")).alias("size"))
    a = stats.select("lang", "source", F.col("p0").alias("a0"), "n_terms")
    b = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    both = a.join(b, "lang").where("source <> item")
    zeros = F.sum(F.col("size") * (distance(F.col("p"), F.col("b0")) - distance(F.col("a0"), F.col("b0"))))
    others = F.sum(F.col("size") * (distance(F.col("a0"), F.col("p")) - distance(F.col("a0"), F.col("b0"))))
    key = ["lang", "source", "item"]
    mine = both.join(sizes, ["lang", "source"]).groupBy(key).agg(zeros.alias("mine"))
    theirs = both.join(sizes.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy(key).agg(others.alias("theirs"))
    base = F.coalesce(F.col("n_terms") * distance(F.col("a0"), F.col("b0")), F.lit(0))
    made = both.join(mine, key, "left").join(theirs, key, "left").join(joint, key, "left")
    value = base + F.coalesce("mine", F.lit(0)) + F.coalesce("theirs", F.lit(0)) + F.coalesce("joint", F.lit(0))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = made.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return out.withColumn("rank", F.row_number().over(w))


def terms(kept: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    met = kept.join(stats.select("lang", "source", "n_tokens", "n_terms", "lang_tokens"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("n_tokens"), F.col("n_terms")), share(F.col("total"), F.col("lang_tokens"), F.col("n_terms"))
    more = met.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = more.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
