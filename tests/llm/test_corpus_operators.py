"""Operators that compare documents, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from geoloom.llm import bloom, components, exact_dedup, line_dedup, mixing, sharding, simhash, weak_labels
from .conftest import SCHEMA, edge_rows, prose

SPACE = r"[\x20\x09-\x0D]"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# operator 3


def test_shards(spark, no_docs, edge_docs):
    rnd = random.Random(1)
    rows = [(i, prose(rnd.randint(1, 60), i % 7), "en", "hot" if i % 3 else f"s{i}", 0, "", 0) for i in range(1500)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 1500 and {r["law"] for r in got} == {"bytes"}
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        text = rows[r["doc_id"]][1].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(size.values()) / 24
    assert set(size) == set(range(24)) and max(abs(s - mean) for s in size.values()) < 0.08 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    edge = sharding.shard_documents(edge_docs).collect()
    assert len(edge) == len(edge_rows()) and {r["size"] for r in edge if r["doc_id"] == 0} == {8}
    assert sharding.shard_documents(no_docs).collect() == []


def brute_tree(rows, shards):
    """Boxes cut one by one at the row nearest to the goal of bytes, along the widest dimension; the dimensions that were cut."""
    whole, cuts = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in sharding.DIMENSIONS}, []

    def cut(box, first, n):
        if n == 1:
            return {r["doc_id"]: first for r in box}
        width = {d: (max(r[d] for r in box) - min(r[d] for r in box)) / max(whole[d], 1) for d in sharding.DIMENSIONS}
        dim = max(width, key=width.get) if any(width.values()) else sharding.LAST
        cuts.append(dim)
        box = sorted(box, key=lambda r: (r[dim], r["tie"]))
        goal, run, at = sum(r["size"] for r in box) * (n // 2) / n, 0, 0
        while run + box[at]["size"] < goal:
            run, at = run + box[at]["size"], at + 1
        at += goal - run >= run + box[at]["size"] - goal
        return cut(box[:at], first, n // 2) | cut(box[at:], first + n // 2, n - n // 2)

    return cut(rows, 0, shards), cuts


def test_cuts_are_those_of_a_brute_force_tree(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd.randint(1, 200), i), rnd.choice(["en", "de", "fr", "es"]), "hot" if i % 3 else f"s{rnd.randint(0, 9)}", 0, "", 0) for i in range(700)]
    table = sharding.metadata(spark.createDataFrame(rows, SCHEMA)).cache()
    want, cuts = brute_tree(table.collect(), 24)
    assert {r["doc_id"]: r["shard"] for r in sharding.tree(table, 24).collect()} == want
    assert len(set(cuts)) >= 3 and sharding.LAST not in cuts


# operator 4


def test_rates_meet_the_targets(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([1, 0.3, 0.2], 400)
    rows = [(i, int(r.integers(1, 500)), *map(float, p[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p_clean double, p_low double, p_toxic double")
    want = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    got = mixing.fit_rates(df, want).collect()
    total = np.array([[x["tokens"] * x[f"p_{d}"] * x["rate"] for d in want] for x in got]).sum(axis=0)
    assert total / total.sum() == pytest.approx(list(want.values()), abs=2e-3) and min(x["rate"] for x in got) >= 0


def test_mix_on_edges(edge_docs, no_docs, labels):
    got = mixing.mix(edge_docs, labels).collect()
    assert len(got) == len(edge_rows()) and all(abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-6 and 0 <= r["rate"] <= 4 for r in got)
    assert mixing.mix(no_docs, labels).collect() == []
    kept = mixing.mixed(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() <= len(edge_rows())


# operator 5


def test_exact_dedup(edge_docs, no_docs):
    groups = defaultdict(list)
    for row in edge_rows():
        groups[re.sub(SPACE, "", row[1] or "")].append(row)
    want = []
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want += [(r[0], keep, len(rows), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()) for r in rows]
    assert sorted(map(tuple, exact_dedup.exact_dedup(edge_docs).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(no_docs).collect() == []


def test_cuckoo_filter_inserts_deletes_and_grows():
    live, digests = exact_dedup.CuckooFilter(8), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    assert all(live.insert(d, i) for i, d in enumerate(digests)) and live.resizes > 3
    assert not any(live.insert(d) for d in digests[:100]) and all(map(live.contains, digests))
    assert all(live.delete(d) for d in digests[::2]) and not live.delete(digests[0])
    assert all(map(live.contains, digests[1::2])) and live.get(digests[1]) == 1 and live.get(digests[0]) is None
    assert sum(map(live.contains, digests[::2])) < 30 and len(list(live.items())) == 1500


def test_deletion_from_the_index(edge_docs, spark):
    rows = exact_dedup.digests(edge_docs).cache()
    gone = rows.where("doc_id = 4").select("digest")
    left = exact_dedup.live_index(rows, rows.count(), gone)
    assert left.count() == rows.select("digest").distinct().count() - 1 and left.join(gone, "digest", "left_semi").count() == 0


# operator 7


def brute_lines(rows):
    key = lambda line: low(re.sub(f"^{SPACE}+|{SPACE}+$", "", line))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10 and r[0] is not None:
                holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (r[0] is not None and len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) < r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark, edge_docs, no_docs, monkeypatch):
    rnd = random.Random(3)
    pool = [prose(4, i) + f" {i}" for i in range(60)] + ["short", "", "  ", "ÀÉ line of ten", "Same Line Here"]
    rows = [(i, "\n".join(rnd.choice([x, x.upper(), f" {x}\t"]) for x in rnd.choices(pool, k=rnd.randint(0, 9))), "en", "s", 0, "", 0) for i in range(150)]
    for data in (rows, edge_rows()):
        df = spark.createDataFrame(data, SCHEMA).repartition(3)
        assert sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=str) == sorted(brute_lines(data), key=str)
    want = {r[0]: r[3] for r in brute_lines(rows)}
    whole = line_dedup.without_repeated_lines(spark.createDataFrame(rows, SCHEMA))
    assert whole.columns == edge_docs.columns and {r["doc_id"]: r["text"] for r in whole.collect()} == want
    full = bloom.filter_of
    monkeypatch.setattr(line_dedup, "filter_of", lambda hashes: full(hashes, 8))  # a filter that is full: all lines are suspected
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_bloom_filter_forgets_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "SLICE_BITS", 1 << 13)  # 2,000 keys fill more than one slice
    h = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    made = bloom.filter_of(spark.createDataFrame([(int(x),) for x in h[:2000].view(np.int64)], "hash long").repartition(5))
    assert made.slices == 8
    one = bloom.Bloom(1 << 16, slices=8)
    one.add(h[:2000])
    assert (made.data == one.data).all() and made.has(h[:2000]).all() and made.has(h[2000:]).mean() < 0.05


def test_rows_are_dropped_by_their_content(edge_docs, spark):
    gone = edge_docs.select(*[c.alias(k) for k, c in bloom.row_keys(edge_docs).items()], "doc_id", "text").where("doc_id is null or doc_id in (0, 4, 7)").select("__key1", "__key2").distinct()
    left = bloom.drop_rows(edge_docs, gone)
    want = [r for r in edge_rows() if r[0] not in (None, 0, 4, 7)]
    assert left.columns == edge_docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "__key1 long, __key2 long")
    assert bloom.drop_rows(edge_docs, none).count() == len(edge_rows())


# operator 9


def test_weak_labels(spark, edge_docs, no_docs):
    rnd, syllables = random.Random(1), "the er ing tion an on ed sh ble rea".split()
    text = lambda: "\n".join(" ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(12)).capitalize() + "." for _ in range(9))
    junk = lambda: " ".join("".join(rnd.choices(syllables, k=2)) + rnd.choice(["***", "$$$", "%%%"]) for _ in range(80))
    docs = spark.createDataFrame([(i, junk() if i % 5 == 0 else text(), None, None, 0, "", 0) for i in range(300)], SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in weak_labels.score_quality(docs).collect()}
    assert sum(got[i] == (i % 5 > 0) for i in range(300)) / 300 > 0.97
    assert weak_labels.score_quality(edge_docs).count() == len(edge_rows()) and weak_labels.score_quality(no_docs).collect() == []


def test_accuracies_are_recovered():
    r = np.random.default_rng(5)
    true, right = r.random(20000) < 0.8, (0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.7, 0.9, 0.6, 0.65)
    marks = np.array([np.where(r.random(20000) < p, true, ~true) for p in right]).T
    patterns = defaultdict(int)
    for row in marks:
        patterns["".join("+" if v else "-" for v in row)] += 1
    accuracy, share, good = weak_labels.estimate(dict(patterns))
    assert accuracy == pytest.approx(right, abs=0.03) and share == pytest.approx(0.8, abs=0.03) and good["+" * 10] > 0.99


# operator 10


def brute_fingerprint(text):
    w = low(text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """The least id that each id reaches."""
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_near_duplicates(spark, edge_docs, no_docs):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(160):
        base = rnd.choices(words, k=120) if i % 4 == 0 else list(rows[-1][1].split(" "))
        if i % 4:
            base[rnd.randrange(len(base))] = "CHANGED"
        rows.append((i, " ".join(base), "en", "s", 0, "", 0))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints) and len(set(brute_components(prints).values())) < 150
    edge = simhash.near_duplicates(edge_docs).collect()
    assert len(edge) == len(edge_rows()) and {r["component_id"] for r in edge if r["doc_id"] in (0, 1, 2)} == {0} and {r["component_id"] for r in edge if r["doc_id"] in (4, 5, None)} == {4}
    assert simhash.near_duplicates(no_docs).collect() == []
    stay = simhash.one_of_each_group(edge_docs)
    assert stay.columns == edge_docs.columns and {r["doc_id"] for r in stay.collect()} >= {0, 3, 4} and 5 not in {r["doc_id"] for r in stay.collect()}


def test_dense_cells_keep_every_link():
    r = np.random.default_rng(1)
    f = np.unique(np.array([sum(1 << int(b) for b in set(r.integers(0, 64, r.integers(0, 6)))) for _ in range(400)], np.uint64))
    u, v = simhash._midpoint_links(f, 2)
    root = {int(x): int(x) for x in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(u, v):
        root[max(find(int(a)), find(int(b)))] = min(find(int(a)), find(int(b)))
    want = brute_components({int(x): int(x) for x in f})
    assert {x: find(x) for x in want} == want


def test_manhattan_distance_is_a_lower_bound():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 2**63, 500).astype(np.uint64), r.integers(0, 2**63, 500).astype(np.uint64)
    bound = np.abs(simhash.segment_counts(a).astype(int) - simhash.segment_counts(b).astype(int)).sum(axis=1)
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 300: 300, 301: 300}


def test_pipeline_runs_over_edges(spark, edge_docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == edge_docs.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    spark.createDataFrame([], edge_docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
