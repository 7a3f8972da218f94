"""Source divergence, packing and spelling variants, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import ceil

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from geoloom.llm import divergence, packing, queries, spelling
from .conftest import SCHEMA, edge_rows, prose

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# operator 11


def brute_divergence(rows, least=3, top=200):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ([x or "" for x in r] for r in rows):
        terms = pattern.findall(text.translate(LOW))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in groups:
        kept = [t for t, c in docs[lang].items() if c >= least]
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in groups[lang]}, share(sum((n[lang, s] for s in groups[lang]), Counter()))
        for s in groups[lang]:
            found = {"pair": [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups[lang] - {s}]}
            found["term"] = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in found.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def divergence_rows(df, **more):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(df, **more).collect())


def test_divergence_on_edges(edge_docs, no_docs):
    assert divergence_rows(edge_docs) == brute_divergence([r[1:4] for r in edge_rows()])
    assert divergence_rows(edge_docs, top=1) == brute_divergence([r[1:4] for r in edge_rows()], top=1)
    assert divergence.divergence(no_docs).collect() == []


def test_divergence_of_many_sources_meets_in_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfghé" for b in "aeiouyÅö"] + ["日本", "z"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de"]), f"s{rnd.randint(0, 8)}", 0, "", 0) for i in range(300)]
    monkeypatch.setattr(divergence, "BLOCK", 3)
    assert divergence_rows(spark.createDataFrame(rows, SCHEMA)) == brute_divergence([r[1:4] for r in rows])


def test_shares_are_exact_for_huge_counts(spark):
    n, total = 9_000_000_000_000_000, 9_200_000_000_000_000
    df = spark.createDataFrame([(n, total, 5)], "n long, total long, terms long")
    assert df.select(divergence.share(df.n, df.total, df.terms)).first()[0] == 1 + 1000000000 * (n + 1) // (total + 5)


def test_divergence_sql_says_the_same(spark, tmp_path, edge_docs):
    edge_docs.toPandas().to_parquet(tmp_path / "d.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    got = db.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP11_SQL})").fetchall()
    assert sorted(got) == divergence_rows(edge_docs)


# operator 12


def check_packing(rows, got, capacity=packing.CAPACITY):
    """The pieces are those of the library's ids, and each sequence is filled gaplessly up to the capacity."""
    library = Tokenizer.from_file(packing.default_path())
    want = Counter()
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_on_edges(edge_docs, no_docs):
    got = packing.pack(edge_docs).collect()
    least = ceil(sum(r.length for r in got) / packing.CAPACITY)
    assert check_packing([r[:2] for r in edge_rows()], got) <= least + 1
    assert packing.pack(no_docs).collect() == []


def test_packing_of_small_sequences(spark):
    rnd = random.Random(2)
    rows = [(i, prose(int(rnd.expovariate(1 / 25)), i), "en", "s", 0, "", 0) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity=128).collect()
    assert check_packing([r[:2] for r in rows], got, 128) <= 1.01 * ceil(sum(r.length for r in got) / 128) + 1


def test_word_wise_ids_are_those_of_whole_texts():
    library, own, rnd = Tokenizer.from_file(packing.default_path()), packing.Encoder(packing.default_path()), random.Random(3)
    odd = [0x300, 0x301, 0x344, 0x2000, 0x2003, 0x2028, 0x3000, 0x85, 0xA0, 0x1C, 0x1F, 0x130, 0x3A3, 0x1F600, 0xAC00, 0x1100, 0x1161, 0x11A8, 0x212B]
    letters = [chr(c) for c in (*range(300), *odd)] + [" "] * 60
    for i in range(1500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) + ("<|endoftext|> a<|startoftext|>b" if i % 50 == 0 else "")
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(len(w) <= packing.LONGEST for w in own.known)


def test_plans_fill_sequences():
    rnd = random.Random(7)
    for _ in range(60):
        capacity = rnd.choice([10, 64, 500])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 40) for _ in range(rnd.randint(0, 40))}
        made = packing.plan(counts, capacity)
        filled, seen = defaultdict(list), Counter()
        for n, first, count, each, sequence, offset in made.steps:
            assert first == seen[n]
            seen[n] += count
            for j in range(count):
                filled[sequence + j // each].append((offset + j % each * n, n))
        assert seen == Counter(counts) and sorted(filled) == list(range(made.sequences))
        for parts in filled.values():
            ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity


def test_exact_complements_leave_no_gap():
    # a single, a pair and a triple fill up; best fit alone would put 60 + 40 first and leave gaps
    made = packing.Plan({60: 1, 40: 1, 70: 1, 20: 1, 10: 1, 81: 1, 9: 1, 6: 1, 4: 1}, 100)
    assert made.sequences == 3


# operator 13


def brute_variants(rows, least=2, times=10):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= least}
    spelt, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            spelt[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), same in spelt.items():
        for w in same:
            near[w] |= same - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= times * words[w]:
            form[w] = best
    root = lambda w: root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def spelling_rows(df, **more):
    return sorted(tuple(r) for r in spelling.spelling_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def typos():
    """Few letters, so that words are near each other in many ways; chains of forms; runs of one letter; very long words."""
    rnd = random.Random(11)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(7, 9))) for _ in range(150)] + ["a" * 7, "a" * 8, "A" * 9, "÷×ÿÀabc"]
    long = "".join(rnd.choice("xyz") for _ in range(spelling.LONG))
    stems += [long, long + "x", long[:50] + long[51:] + "q", long + "xq", long[:60] + "w" + long[60:], "z" * 3000, "z" * 3001, "z" * 2999 + "y", long[:-1] + "ö"]
    weights = [1 / (1 + i % 40) ** 2 for i in range(len(stems))]
    texts = [" ".join(rnd.choices(stems, weights, k=rnd.randint(0, 80))) for _ in range(120)]
    texts += [f"{w} {w}," for w in stems[-9:]] + ["firstform " * 500 + "firstforn " * 30 + "firstfern " * 2]
    return [(i, t, "en", "s", 0, "", 0) for i, t in enumerate(texts)] + [(None, texts[0], None, None, 0, "", 0), (3, texts[3], "en", "s", 0, "", 0), (500, None, None, None, 0, "", 0)]


@pytest.mark.parametrize("most", [4, 40, 8192])
def test_variants(spark, typos, most):
    want = brute_variants([r[:2] for r in typos])
    assert spelling_rows(spark.createDataFrame(typos, SCHEMA).repartition(3), most=most) == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_variants_on_edges(edge_docs, no_docs):
    assert spelling_rows(edge_docs) == brute_variants([r[:2] for r in edge_rows()])
    assert spelling.spelling_variants(no_docs).collect() == []


def test_acceptor_is_minimal():
    a = spelling.Acceptor(["", "bat", "bats", "cat", "cats"])
    assert len(a.next) == 5 and a.ends[a.start]
    assert spelling.Acceptor([]).ends == [False] and spelling.Acceptor([""]).ends == [True]
