"""Near copies by similarity: fingerprints of passages find candidates, word shingles verify them (the pipeline's near-dedup)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import filter_of, parted, row_keys
from .common import arrow_schema, byte_texts, durable, join_skewed, map_batches, parts_for, to_batch, whole_texts
from .components import components
from .simhash import fingerprints, links

#: Words of a shingle, and the share of shingles that near copies have in common.
SHINGLE, SIMILARITY = 5, 0.8
#: Words of a passage, and passages that a text is searched by: those of the least hashes, so that near copies choose alike.
#: At a similarity of 0.8 about 64 % of all passages are common, so two texts share none of 8 with a chance of 0.0003.
PASSAGE, PASSAGES = 10, 8
#: A sketch has the least shingle hash of each of 64 bins in a byte; at 0.8 its estimate has a deviation of 0.05, so pairs
#: estimated at PROBABLE or more are verified, and those at STRONG or more spare the search of a large run more of them.
BINS, PROBABLE, STRONG = 64, 0.6, 0.9
#: All probable pairs of runs up to this length are verified at once. In longer ones a text first meets its BEST likeliest
#: partners and the run's PIVOTS, those that are like most others; what is still apart then meets in a second search.
SMALL_RUN, BEST, PIVOTS = 64, 4, 8
RUN_ROWS = 200_000
#: The second search has of each text its least shingle hashes: all of them up to MARKS, fewer in runs of so many texts that a task
#: would hold more than RUN_MARKS. Where some are left out, pairs within SLACK deviations of the similarity are verified.
MARKS, LEAST_MARKS, RUN_MARKS, SLACK = 2048, 64, 8 << 20, 5


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from the words' hashes; one hash of all words if there are fewer."""
    n = min(n, len(h))
    key = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


def sketch(words: list[bytes]) -> tuple[int, bytes, list[bytes]]:
    """The number of different shingles of a text's words, its sketch (0: an empty bin) and the passages to search by."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    five = np.unique(_rolled(h, SHINGLE))
    bins, first = np.unique(five >> np.uint64(58), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(int)] = five[first] % np.uint64(255) + np.uint64(1)
    at = np.unique(_rolled(h, PASSAGE), return_index=True)[1][:PASSAGES]
    return len(five), out.tobytes(), [b" ".join(words[i : i + PASSAGE]) for i in at]


def similarity(a: bytes, b: bytes) -> float:
    """The exact Jaccard similarity of two texts' word shingles."""
    x, y = ({tuple(w[i : i + SHINGLE]) for i in range(max(len(w) - SHINGLE, 0) + 1)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id and row_keys() of each row, digest of the words, and of texts with words the number of shingles, sketch and
    fingerprints of passages."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: batch[k] for k in ("doc_id", "__key1", "__key2")} | {"digest": [], "n": [], "sketch": [], "fps": []}
        for t in byte_texts(batch["text"]):
            words = t.lower().split()
            n, bits, passages = sketch(words) if words else (0, b"", [])
            out["digest"].append(xxhash.xxh128_digest(b" ".join(words)))
            out["n"].append(n)
            out["sketch"].append(bits)
            out["fps"].append(np.unique(fingerprints(passages).view(np.int64)).tolist())
        return out

    return map_batches(_keyed(docs), run, "doc_id long, __key1 long, __key2 long, digest binary, n long, sketch binary, fps array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return whole_texts(docs, *[c.alias(k) for k, c in row_keys(docs).items()])


def _estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarities of a sketch and many: equal bins among those that either has."""
    return ((one == many) & (one > 0)).sum(axis=1) / np.maximum(((one > 0) | (many > 0)).sum(axis=1), 1)


def run_pairs(node: np.ndarray, n: np.ndarray, bits: np.ndarray, best: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probable pairs of texts that share a passage.

    Texts of which the smaller has less than SIMILARITY of the larger's shingles can't be near copies. In a long run the
    texts that strong pairs reach are walked through before any other, and each meets all that are not reached yet; so
    pairs of two such parts all come, and within a part enough of them to connect it. With `best`, each gives its strong
    pairs and its `best` other ones alone, and the PIVOTS give all of theirs: a number of pairs that grows with the run, not
    its square. pairs_apart() finds what these leave out.
    """
    node, n, bits, low, high = _by_size(node, n, bits)
    left, us, vs = np.ones(len(node), bool), [node[:0]], [node[:0]]
    liked, long = np.zeros(len(node)), len(node) > SMALL_RUN
    for first in range(len(node)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue:
            i = queue.pop()
            to = low[i] + np.flatnonzero(left[low[i] : high[i]])
            if not len(to):
                continue
            value = _estimates(bits[i], bits[to])
            near, value = to[value >= PROBABLE], value[value >= PROBABLE]
            if long:
                liked[near] += value
                liked[i] += value.sum()
                strong = near[value >= STRONG]
                left[strong] = False
                queue.extend(strong.tolist())
                if best is not None:
                    near, value = near[value < STRONG], value[value < STRONG]
                    near = np.concatenate([strong, near[np.argsort(-value, kind="stable")[:best]]])
            us.append(np.full(len(near), node[i]))
            vs.append(node[near])
    for i in np.argsort(-liked, kind="stable")[: PIVOTS if long and best is not None else 0].tolist():
        near = low[i] + np.flatnonzero(_estimates(bits[i], bits[low[i] : high[i]]) >= PROBABLE)
        near = near[near != i]
        us.append(np.full(len(near), node[i]))
        vs.append(node[near])
    return np.concatenate(us), np.concatenate(vs)


def first_pairs(node: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return run_pairs(node, n, bits, BEST)


def pairs_apart(node: np.ndarray, n: np.ndarray, bits: np.ndarray, root: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a long run that are alike by their marks (sorted arrays of shingle hashes) and that no verified links connect
    yet (root: what they are connected to).

    Each such pair has a text outside the run's largest root, so these alone are compared with the run, each by the texts that
    have its marks. Where both have all their shingles as marks, the pairs are just those of a similarity of SIMILARITY.
    """
    if len(node) <= SMALL_RUN:
        return node[:0], node[:0]
    node, n, bits, low, high, root, marks = _by_size(node, n, bits, root, marks)
    names, held = np.unique(root, return_counts=True)
    size = np.array([len(m) for m in marks])
    ends = np.append(0, np.cumsum(size))
    of = np.unique(np.concatenate(marks), return_inverse=True)[1]
    order = np.argsort(of, kind="stable")
    owner, starts = np.repeat(np.arange(len(node)), size)[order], np.append(0, np.cumsum(np.bincount(of)))
    us, vs = [node[:0]], [node[:0]]
    for i in np.flatnonzero(root != names[held.argmax()]).tolist():
        to = low[i] + np.flatnonzero(root[low[i] : high[i]] != root[i])
        having = [owner[starts[k] : starts[k + 1]] for k in of[ends[i] : ends[i + 1]].tolist()]
        if not len(to) or not having:
            continue
        common = np.bincount(np.concatenate(having), minlength=len(node))[to]
        whole = (size[to] == n[to]) & (size[i] == n[i])
        alike = whole & (common >= SIMILARITY * (size[i] + size[to] - common) - 1e-9)
        for k in np.flatnonzero(~whole & (common > 0)).tolist():  # texts of which some shingles are left out, up to the lesser end
            a, b = marks[i], marks[to[k]]
            till = min(x[-1] if len(x) < m else np.uint64(2**64 - 1) for x, m in ((a, n[i]), (b, n[to[k]])))
            either = np.searchsorted(a, till, "right") + np.searchsorted(b, till, "right") - common[k]
            alike[k] = common[k] / either >= SIMILARITY - SLACK * (SIMILARITY * (1 - SIMILARITY) / either) ** 0.5
        us.append(np.full(int(alike.sum()), node[i]))
        vs.append(node[to[alike]])
    return np.concatenate(us), np.concatenate(vs)


def _by_size(node: np.ndarray, n: np.ndarray, bits: np.ndarray, *more: np.ndarray) -> tuple:
    """The rows by number of shingles, and from where to where each has rows of a size that it can be like."""
    order = np.lexsort((node, n))
    n = n[order]
    low, high = np.searchsorted(n, np.ceil(n * SIMILARITY - 1e-9)), np.searchsorted(n, np.floor(n / SIMILARITY + 1e-9), "right")
    return node[order], n, bits[order], low, high, *[m[order] for m in more]


def _candidates(rows: DataFrame, count: int, search=first_pairs, *more: str, marks: bool = False) -> DataFrame:
    """a, b: pairs that `search` gives of texts (key, node, n, sketch, the columns of numbers `more`, and marks) that share a
    key; keys stream by, sorted."""
    schema = "a long, b long"
    met = rows.repartition(parts_for(count, RUN_ROWS), "key").sortWithinPartitions("key")
    arrow = arrow_schema(met, schema)

    def pairs(parts: list) -> pa.RecordBatch:
        key, node, n, *rest = (np.concatenate([p[i] for p in parts]) for i in range(3 + len(more)))
        bits = np.frombuffer(b"".join(x for p in parts for x in p[3 + len(more)]), np.uint8).reshape(-1, BINS)
        if marks:
            rest.append(np.empty(len(key), object))
            rest[-1][:] = [np.frombuffer(x, np.uint64) for p in parts for x in p[-1]]
        starts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        got = [search(*_once(*[x[a:z] for x in (node, n, bits, *rest)])) for a, z in zip(starts[:-1], starts[1:]) if z - a > 1]
        u, v = (np.concatenate([g[i] for g in got]) if got else node[:0] for i in range(2))
        return to_batch({"a": np.minimum(u, v), "b": np.maximum(u, v)}, arrow)

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            row = [*[b[c].to_numpy() for c in ("key", "node", "n", *more)], *[b[c].to_pylist() for c in lists]]
            key = row[0]
            at = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if at or (held and held[-1][0][-1] != key[-1]):
                yield pairs([*held, [x[:at] for x in row]])
                held = []
            held.append([x[at:] for x in row])
        if held:
            yield pairs(held)

    lists = ["sketch", "marks"] if marks else ["sketch"]
    return met.select("key", "node", "n", *more, *lists).mapInArrow(run, schema).distinct()


def _once(node: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    at = np.unique(node, return_index=True)[1]
    return [x[at] for x in (node, *more)]


def _with_texts(pairs: DataFrame, texts: DataFrame, side: str) -> DataFrame:
    """The pairs with the text of one side; a text of many pairs is not gathered with all of them."""
    held = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("held"))
    found = durable(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")).join(held.hint("merge"), side))
    return join_skewed(pairs, found, side, "held", pairs.count())


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketched rows of docs; of these the row that stands for each doc_id (doc_id, first: the least doc_id with the same
    words); and the verified links (a, b) of such first ids.

    Linked are texts whose five-word shingles have a Jaccard similarity of 0.8 or more, verified on the words themselves.
    Candidates are texts of which a passage's fingerprints differ in at most 2 bits (as simhash.links() finds them) or are
    joined by such. Texts are lower-cased in A-Z and cut at ASCII white space; one with fewer words than a shingle is one.
    Of rows that share a doc_id, the least by a hash of its content stands for it. Only texts of candidates are shuffled.
    """
    rows = durable(_sketched(docs))
    by = Window.partitionBy("doc_id").orderBy("__key1", "__key2")
    named = durable(rows.where("doc_id is not null").withColumn("__row", F.row_number().over(by)).where("__row = 1").drop("__row"))
    firsts = durable(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held")))
    named = durable(join_skewed(named, firsts, "digest", "held", named.count()).drop("held"))
    passages = durable(named.where("doc_id = first").select(F.col("doc_id").alias("node"), "n", "sketch", F.explode("fps").alias("fp")))
    total = passages.count()
    groups = durable(passages.groupBy("fp").agg(F.count(F.lit(1)).alias("held")))
    found = components(links(groups, groups.count())).withColumnRenamed("node", "fp")
    keyed = durable(groups.join(found, "fp", "left").select("fp", "held", F.coalesce("root", "fp").alias("key")))
    shared = keyed.groupBy("key").agg(F.sum("held").alias("all")).where("`all` > 1").select("key")
    shared = durable(keyed.join(shared, "key", "left_semi"))
    met = durable(join_skewed(passages, shared, "fp", "held", total).select("key", "node", "n", "sketch"))
    count = met.count()
    pairs = durable(_candidates(met, count))
    linked = durable(_verified(docs, named, pairs))
    # what the first search leaves out: pairs of long runs between texts that are not connected by now
    held = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
    runs = met.groupBy("key").agg(F.count(F.lit(1)).alias("run")).where(F.col("run") > SMALL_RUN)
    long = durable(join_skewed(met, durable(runs), "key", "run", count))
    marked = _marked(docs, named, durable(long.groupBy(F.col("node").alias("doc_id")).agg(F.max("run").alias("run"))))
    apart = long.join(held.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).join(marked.hint("merge"), "node")
    later = durable(_candidates(apart, count, pairs_apart, "root", marks=True).join(pairs.hint("merge"), ["a", "b"], "left_anti"))
    return rows, named, durable(linked.unionByName(_verified(docs, named, later)))


def _texts_of(docs: DataFrame, named: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of ids (doc_id, each once), of the rows that stand for them. No other texts are shuffled."""
    wanted = durable(ids.join(named.select("doc_id", "__key1", "__key2"), "doc_id"))
    texts, _ = parted(_keyed(docs), filter_of(wanted.select(F.col("__key1").alias("hash"))), "__key1")
    # repeated rows share their keys, so one of each is enough
    return durable(texts.join(wanted.hint("merge"), ["doc_id", "__key1", "__key2"]).dropDuplicates(["doc_id"]).drop("__key1", "__key2"))


def _marked(docs: DataFrame, named: DataFrame, ids: DataFrame) -> DataFrame:
    """node and marks, its least shingle hashes, of ids (doc_id, run: the size of its longest run)."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for t, most in zip(byte_texts(batch["text"]), batch["run"].to_pylist()):
            words = t.lower().split()
            five = np.unique(_rolled(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), SHINGLE))
            out.append(five[: min(MARKS, max(LEAST_MARKS, RUN_MARKS // most))].tobytes())
        return {"node": batch["doc_id"], "marks": out}

    return durable(map_batches(_texts_of(docs, named, ids).select("doc_id", "text", "run"), run, "node long, marks binary"))


def _verified(docs: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of `pairs` whose texts are near copies."""
    texts = _texts_of(docs, named, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = _with_texts(durable(_with_texts(pairs, texts, "a").select("a", "b", "text_a")), texts, "b").select("a", "b", "text_a", "text_b")

    def verify(batch: pa.RecordBatch) -> dict:
        good = [similarity(x, y) >= SIMILARITY for x, y in zip(byte_texts(batch["text_a"]), byte_texts(batch["text_b"]))]
        return {"a": batch["a"].filter(pa.array(good)), "b": batch["b"].filter(pa.array(good))}

    return map_batches(both, verify, "a long, b long")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which one of each group of linked near copies stays: that of the smallest doc_id.

    A doc_id and text that rows repeat stays once. Of different texts with one doc_id, one stands for it in its group and
    the others, which no link can name, stay; so do rows without a doc_id. Texts without words are copies of each other.
    """
    rows, named, linked = near_copies(docs)
    found = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
    lost = found.where("node <> root").select(F.col("node").alias("doc_id")).distinct()
    gone = durable(named.where("doc_id <> first").unionByName(named.where("doc_id = first").join(lost, "doc_id", "left_semi")).select("__key1", "__key2", F.lit(True).alias("gone")))
    again = rows.where("doc_id is not null").groupBy("__key1", "__key2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key1", "__key2", F.lit(False).alias("gone"))
    marked = durable(gone.unionByName(again).groupBy("__key1", "__key2").agg(F.max("gone").alias("__gone")))
    maybe, others = parted(docs.withColumns(row_keys(docs)), filter_of(marked.select(F.col("__key1").alias("hash"))), "__key1")
    met = maybe.join(marked.hint("merge"), ["__key1", "__key2"], "left")
    once = met.where("__gone = false").dropDuplicates(["__key1", "__key2"])
    return others.select(docs.columns).unionByName(met.where("__gone is null").select(docs.columns)).unionByName(once.select(docs.columns))
