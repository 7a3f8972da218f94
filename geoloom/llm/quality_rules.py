"""Quality rules and a modified Kneser-Ney n-gram model whose perplexity bands reject documents (operator 8)."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import drop_rows, row_keys
from .common import arrow_schema, byte_texts, chunks, durable, to_batch, whole_texts

SYMBOLS = b"#*$%&|<>"
WHITE_SPACE = b" \t\n\x0b\x0c\r"
NO_LETTER = bytes(c for c in range(128) if not chr(c).isalnum())
#: Bytes of a gram. Words are joined by one blank, so grams cross word ends; GRAM - 1 line ends stand before a text.
GRAM = 5
#: The most frequent grams, at most so many, are broadcast to the scorers; all others meet the model in a shuffle.
HEAD_GRAMS = 1 << 18
#: A document may lie so many robust deviations of its language below and above the median, and NOISE / sqrt(its letters) more.
LOW, HIGH, NOISE = 8.0, 6.0, 2.0
#: Least deviation (nats a letter), and documents at which a language's deviation is doubled, as so few say little of it.
LEAST_SPREAD, FEW_DOCS = 0.02, 20
#: Grams that a task holds before it sends what it has counted.
MOST_HELD = 600_000
BIN = 2000


def language(lang: Column) -> Column:
    """The language of a tag: its first two or three letters ("en-GB": en), "und" for null or anything else. So there are at
    most 26 ** 2 + 26 ** 3 + 1 = 18,253 languages, and tables with a row for each are broadcast."""
    found = F.lower(F.regexp_extract(F.coalesce(lang.cast("string"), F.lit("")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(found == "", "und").otherwise(found)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of texts one after the other, packed into 64-bit numbers, and how many each text has: one for each byte of
    its words joined by blanks, and one for the end; none without a word."""
    words = [b" ".join(t.split()) for t in texts]
    n = np.array([len(w) + 1 if w else 0 for w in words], np.int64)
    data = np.frombuffer(b"".join(b"\n" * (GRAM - 1) + w + b" " for w in words if w), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), n
    key = np.zeros(len(data) - GRAM + 1, np.int64)
    for k in range(GRAM):
        key = key << 8 | data[k : len(data) - GRAM + 1 + k]
    full = n[n > 0]
    starts = np.cumsum(full + GRAM - 1) - (full + GRAM - 1)
    at = np.repeat(starts - (np.cumsum(full) - full), full) + np.arange(full.sum())
    return key[at], n


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each gram occurs in each language of the whole corpus. Tasks count first, Spark sums."""
    schema = "lang string, gram long, n long"
    arrow = arrow_schema(docs, schema)

    def run(batches):
        held: dict[str, list] = defaultdict(list)

        def flush():
            for lang, parts in held.items():
                key, n = _merged(parts)
                yield to_batch({"lang": [lang] * len(key), "gram": key, "n": n}, arrow)
            held.clear()

        for b in batches:
            langs, raw = b["lang"].to_pylist(), byte_texts(b["text"])
            for a, z in chunks(raw):
                by: dict[str, list[bytes]] = defaultdict(list)
                for lang, t in zip(langs[a:z], raw[a:z]):
                    by[lang].append(t)
                for lang, texts in by.items():
                    held[lang].append(np.unique(grams(texts)[0], return_counts=True))
                if sum(len(p[0]) for parts in held.values() for p in parts) > MOST_HELD:
                    for lang, parts in held.items():
                        held[lang] = [_merged(parts)]
                    if sum(len(p[0]) for parts in held.values() for p in parts) > MOST_HELD // 2:
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """A row per language: how much is taken off grams seen once, twice, and more often."""
    n = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
    c = level.groupBy("lang").agg(*[x.alias(f"n{i + 1}") for i, x in enumerate(n)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    cut = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(0.9 * i), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))))
    return c.select("lang", *[cut(i).alias(f"cut{i}") for i in (1, 2, 3)])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, gram, n, p, held: interpolated modified Kneser-Ney probabilities of the counted grams' last bytes, and those
    that documents are scored by: a gram that the corpus has once is foretold by its own document alone, so it is scored as
    one that is not seen.

    Shorter grams are counted by the different bytes that stand before them. Every join and window works on keys of at most
    256 rows, so no language or byte is hot.
    """
    levels = {GRAM: counts}
    for k in range(GRAM - 1, 0, -1):
        levels[k] = durable(levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    p = None
    for k in range(1, GRAM + 1):
        cut = F.when(F.col("n") == 1, F.col("cut1")).when(F.col("n") == 2, F.col("cut2")).otherwise(F.col("cut3"))
        x = levels[k].join(F.broadcast(_discounts(levels[k])), "lang").select("lang", "gram", "n", cut.alias("cut"), F.shiftright("gram", 8).alias("context"))
        w = Window.partitionBy("lang", "context")
        x = x.withColumns({"all": F.sum("n").over(w), "lost": F.sum("cut").over(w)})
        if p is None:
            x = x.withColumn("lower", F.lit(1 / 256))
        else:
            lower = p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            x = x.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower, ["lang", "suffix"])
        known = (F.col("n") - F.col("cut") + F.col("lost") * F.col("lower")) / F.col("all")
        p = x.select("lang", "gram", "n", known.alias("p"), F.when(F.col("n") == 1, F.col("lost") * F.col("lower") / F.col("all")).otherwise(known).alias("held"))
    return durable(p)


def _count_bin(n: Column) -> Column:
    """Counts in order, in at most 4,500 bins: exact below 1,024, of equal ratios above."""
    return F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 64)).cast("long")


def head_of(model: DataFrame, most: int | None = None) -> tuple[dict, DataFrame]:
    """The most frequent grams, at most `most`, as arrays of each language, and the table of all others."""
    most = HEAD_GRAMS if most is None else most
    bins = sorted(((r["bin"], r["rows"]) for r in model.groupBy(_count_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    least, held = 1 << 62, 0
    for b, rows in bins:
        held += rows
        if held > most:
            break
        least = b
    # as Arrow columns, since a Python object for each gram would take the driver's memory
    top = model.where(_count_bin(F.col("n")) >= least).select("lang", "gram", "held").toArrow().combine_chunks()
    langs = top["lang"].combine_chunks().dictionary_encode()
    code, gram, p = langs.indices.to_numpy(), top["gram"].to_numpy(), top["held"].to_numpy()
    order = np.argsort(code, kind="stable")
    parts = np.split(order, np.searchsorted(code[order], np.arange(1, len(langs.dictionary))))
    tables = {lang: HashArrays(gram[at], -np.log(p[at])) for lang, at in zip(langs.dictionary.to_pylist(), parts)}
    return tables, model.where(_count_bin(F.col("n")) < least)


class HashArrays:
    """Grams as sorted arrays of their hashes, with values; the first bits of a hash say where to look for it."""

    def __init__(self, gram: np.ndarray, value: np.ndarray) -> None:
        h = self._hash(gram)
        order = np.argsort(h)
        self.hashes, self.values = h[order], value[order].astype(np.float32)
        self.bits = max(1, int(len(h)).bit_length())
        self.starts = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def _hash(gram: np.ndarray) -> np.ndarray:
        """An odd factor permutes 64-bit numbers, so different grams have different hashes."""
        return gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def look(self, gram: np.ndarray) -> np.ndarray:
        """The grams' values, NaN where they are not held."""
        h = self._hash(gram)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.starts[top], self.starts[top + 1]
        out = np.full(len(h), np.nan, np.float32)
        left = np.flatnonzero(at < stop)
        while len(left):
            here = self.hashes[at[left]]
            hit = here == h[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (here < h[left])]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


def repeated_words(lists: list[list[bytes]], window: int = 5) -> list[int]:
    """For each list of words, how many stand in windows that the list has twice or more. Hashes propose repeated windows,
    the words themselves confirm them."""
    sizes = np.array([len(x) for x in lists])
    h = np.fromiter((hash(w) for x in lists for w in x), np.int64).view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    if len(h) < window:
        return [0] * len(lists)
    key = np.zeros(len(h) - window + 1, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - window + 1 + k]
    doc = np.repeat(np.arange(len(lists)), sizes)
    key = (key ^ (key >> np.uint64(31))) + doc[: len(key)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(doc[: len(key)] == doc[window - 1 :])
    order = np.argsort(key[at], kind="stable")
    near = key[at][order]
    same = near[1:] == near[:-1]
    again = np.sort(at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]])
    if len(again):
        said = [(d, *lists[d][i - s : i - s + window]) for i, d, s in zip(again.tolist(), doc[again].tolist(), starts[doc[again]].tolist())]
        times = Counter(said)
        again = again[[times[x] > 1 for x in said]]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return (total[starts + sizes] - total[starts]).tolist()


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORES = ("n_letters", "nll", "rare", "times")


def measured(docs: DataFrame, head: dict) -> DataFrame:
    """The rules' numbers of each row (doc_id, lang, text, __key1, __key2), the number of its letters and digits (bytes), the
    negative log probability of its grams in the head, and its other grams with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    schema = f"doc_id long, lang string, __key1 long, __key2 long, {', '.join(f'{k} long' for k in RULES)}, n_letters long, nll double, rare array<long>, times array<long>"
    arrow = arrow_schema(docs, schema)

    def scored(raw: list[bytes], langs: list[str], out: dict) -> None:
        of: dict[str, list[int]] = defaultdict(list)
        for i, lang in enumerate(langs):
            of[lang].append(i)
        got: list = [None] * len(raw)
        for lang, rows in of.items():
            key, n = grams([raw[i] for i in rows])
            cost = shared.value[lang].look(key) if lang in shared.value else np.full(len(key), np.nan, np.float32)
            sums = np.concatenate([[0.0], np.cumsum(np.nan_to_num(cost), dtype=np.float64)])
            ends = np.cumsum(n)
            lost = np.flatnonzero(np.isnan(cost))
            cuts = np.searchsorted(lost, np.concatenate([ends - n, ends[-1:]]))
            for j, i in enumerate(rows):
                rare, times = np.unique(key[lost[cuts[j] : cuts[j + 1]]], return_counts=True) if cuts[j + 1] > cuts[j] else ((), ())
                got[i] = (len(raw[i].translate(None, NO_LETTER)), float(sums[ends[j]] - sums[ends[j] - n[j]]), rare, times)
        for k, name in enumerate(SCORES):
            out[name] += [g[k] for g in got]

    def run(batches):
        for b in batches:
            raw, langs = byte_texts(b["text"]), b["lang"].to_pylist()
            out: dict[str, list] = {k: [] for k in (*RULES, *SCORES)}
            for a, z in chunks(raw):
                lists = [t.split() for t in raw[a:z]]
                out["n_repeat_words"] += repeated_words(lists)
                for t, words in zip(raw[a:z], lists):
                    lines = [x for x in t.split(b"\n") if x.strip()]
                    out["n_words"].append(len(words))
                    out["word_chars"].append(len(t.translate(None, WHITE_SPACE).decode()))
                    out["n_symbols"].append(len(t) - len(t.translate(None, SYMBOLS)))
                    out["n_dup_lines"].append(len(lines) - len(set(lines)))
                scored(raw[a:z], langs[a:z], out)
            yield to_batch(out | {k: b[k] for k in ("doc_id", "lang", "__key1", "__key2")}, arrow)

    return docs.mapInArrow(run, schema)


def _median(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """lang and m, the weighted median of whole numbers. A language has few of them: the bins of the possible range."""
    w = Window.partitionBy("lang")
    run = F.sum(weight).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = rows.groupBy("lang", value).agg(F.sum(weight).alias(weight))
    return summed.withColumns({"run": run, "all": F.sum(weight).over(w)}).where(F.col("run") * 2 >= F.col("all")).groupBy("lang").agg(F.min(value).alias("m"))


def bands(rows: DataFrame) -> DataFrame:
    """lang, low, high: the log perplexities that documents may have, less the allowance for their length.

    rows: lang, x (log perplexity), n_letters and word_chars of documents that the base rules keep. Documents alike in all of
    these count once, so that copies don't make up the middle of a language.
    """
    top = int(BIN * 40)
    x = F.least(F.lit(top), F.floor(F.col("x") * BIN)).cast("long")
    once = rows.select("lang", x.alias("bin"), "n_letters", "word_chars").distinct()
    n = durable(once.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")))
    middle = _median(n, "bin", "n").withColumnRenamed("m", "middle")
    far = n.join(F.broadcast(middle), "lang").withColumn("far", F.abs(F.col("bin") - F.col("middle")))
    of = far.groupBy("lang").agg(F.sum("n").alias("docs"), F.max("middle").alias("middle")).join(_median(far, "far", "n"), "lang")
    spread = F.greatest(F.lit(LEAST_SPREAD), F.col("m") * 1.4826 / BIN) * (1 + FEW_DOCS / F.col("docs"))
    at = (F.col("middle") + 0.5) / BIN
    return of.select("lang", (at - LOW * spread).alias("low"), (at + HIGH * spread).alias("high"))


def _judged(docs: DataFrame) -> DataFrame:
    """The rules' numbers, x (log perplexity), base_failed, kept and the row_keys() of each row."""
    src = whole_texts(docs, language(docs["lang"]).alias("lang"), *[c.alias(k) for k, c in row_keys(docs).items()])
    head, others = head_of(kneser_ney(durable(gram_counts(src.select("lang", "text")))))
    rows = durable(measured(src, head).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.where(F.size("rare") > 0).select("lang", "row", F.explode(F.arrays_zip("rare", "times")).alias("g")).select("lang", "row", "g.rare", "g.times")
    cost = rare.join(others.select("lang", F.col("gram").alias("rare"), "held"), ["lang", "rare"]).groupBy("row").agg(F.sum(-F.log("held") * F.col("times")).alias("more"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    x = F.when(F.col("n_words") > 0, (F.col("nll") + F.coalesce("more", F.lit(0.0))) / F.greatest(F.col("n_letters"), F.lit(1)))
    known = durable(rows.drop("rare", "times").join(cost, "row", "left").withColumns({"x": x, "base_failed": failed}).drop("row", "nll", "more"))
    found = bands(known.where("not base_failed"))
    slack = F.lit(NOISE) / F.sqrt(F.greatest(F.col("n_letters"), F.lit(1)))
    inside = F.coalesce((F.col("x") >= F.col("low") - slack) & (F.col("x") <= F.col("high") + slack), F.lit(True))
    return known.join(F.broadcast(found), "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame) -> DataFrame:
    """The rules' numbers, base_failed and the verdict of each document, with its perplexity.

    A document is kept if it does not fail the base rules and its log perplexity lies within its language's band (bands())
    or at most NOISE / sqrt(letters) outside. The log perplexity is the negative log probability of all bytes, by letter or
    digit: marks between and behind words add to it and don't thin it out. The model is counted on all whole texts of a
    language. A null or empty
    text has no words, fails the base rules and has no perplexity (null). Documents without a language tag form one, "und".
    Repeated rows count each time; an empty table gives no rows; other columns are ignored.
    """
    return _judged(docs).select("doc_id", *RULES, "base_failed", "kept", F.when(F.col("x").isNotNull(), F.exp(F.least(F.lit(700.0), F.col("x")))).alias("perplexity"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that quality_rules() keeps. Each row is judged by its own text and language, so one
    without a doc_id stays or goes like any other, and of rows that share a doc_id each has its own verdict."""
    return drop_rows(docs, durable(_judged(docs).where("not kept").select("__key1", "__key2").distinct()))
