import numpy as np

import corpus_pipeline
from geoloom.llm import near_copies


def altered(words, every, r):
    return [f"new{r.integers(1 << 30)}" if i % every == every // 2 else w for i, w in enumerate(words)]


def test_copies_at_four_fifths_go(spark):
    r = np.random.default_rng(1)
    rows, gone = [], set()
    for k in range(30):
        words = [f"w{x}" for x in r.integers(0, 5000, 300)]
        near, far = " ".join(altered(words, 50, r)), " ".join(altered(words, 20, r))
        a = " ".join(words)
        assert 0.8 <= near_copies.similarity(a.encode(), near.encode()) < 0.84 and near_copies.similarity(a.encode(), far.encode()) < 0.6
        rows += [(3 * k, a), (3 * k + 1, near), (3 * k + 2, far)]
        gone.add(3 * k + 1)
    rows += [(900, "Two words"), (901, "two  WORDS"), (902, "  "), (903, None), (904, "other words"), (5, rows[5][1]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    # the repeated row stays once, the row without an id stays
    assert sorted(kept, key=str) == sorted({x[0] for x in rows} - gone - {901, 903}, key=str)


def test_other_texts_of_an_id_stay(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, "en"), (1, "another text of the same id", "en"), (2, words + " more", "en"), (2, words + " more", "en"), (3, words, "de"), (None, words, "en")]
    kept = near_copies.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    # either text of id 1 may stand for it; where the other one does, id 2 stays, once
    always = [rows[0], rows[1], rows[5]]
    assert sorted(map(tuple, kept), key=str) in (sorted(always, key=str), sorted([*always, rows[2]], key=str))


def test_long_runs_connect_what_all_pairs_connect():
    r = np.random.default_rng(2)
    texts = []
    for _ in range(6):
        words = [f"w{x}" for x in r.integers(0, 5000, 150)]
        texts += [altered(words, 60 + k, r) for k in range(25)]
    made = [near_copies.sketch([x.encode() for x in t]) for t in texts]
    n, bits = np.array([m[0] for m in made]), np.stack([np.frombuffer(m[1], np.uint8) for m in made])
    assert len(texts) > near_copies.SMALL_RUN
    raw = [" ".join(t).encode() for t in texts]

    def parts(pairs):
        root = list(range(len(texts)))
        for _ in texts:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    found = [p for p in zip(*run_lists(n, bits)) if near_copies.similarity(raw[p[0]], raw[p[1]]) >= 0.8]
    every = [(a, b) for a in range(len(texts)) for b in range(a) if near_copies.similarity(raw[a], raw[b]) >= 0.8]
    assert parts(found) == parts(every)


def run_lists(n, bits):
    u, v = near_copies.run_pairs(np.arange(len(n)), n, bits)
    return u.tolist(), v.tolist()


def test_no_documents(spark, no_docs):
    assert near_copies.one_of_each_group(no_docs).collect() == []


def test_two_searches_of_a_long_run_connect_what_all_pairs_connect():
    """Copies of one text that are unlike each other are linked through it alone, with pairs that grow with the run."""
    r = np.random.default_rng(5)
    texts = []
    for _ in range(2):
        words = [f"w{x}" for x in r.integers(0, 5000, 200)]
        texts += [words] + [altered(words, 200, r) for _ in range(90)] + [[*words[:100], *altered(words[100:], 100, r)] for _ in range(9)]
    made = [near_copies.sketch([x.encode() for x in t]) for t in texts]
    n, bits = np.array([m[0] for m in made]), np.stack([np.frombuffer(m[1], np.uint8) for m in made])
    raw = [" ".join(t).encode() for t in texts]
    node = np.arange(len(texts))

    def good(pairs):
        return [(a, b) for a, b in zip(*(x.tolist() for x in pairs)) if near_copies.similarity(raw[a], raw[b]) >= 0.8]

    def roots(pairs):
        root = list(range(len(texts)))
        for _ in texts:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    first = near_copies.first_pairs(node, n, bits)
    linked = good(first)
    marks = np.empty(len(texts), object)
    marks[:] = [np.unique(near_copies._rolled(np.array([near_copies.xxhash.xxh64_intdigest(x.encode()) for x in t], np.uint64), near_copies.SHINGLE)) for t in texts]
    apart = near_copies.pairs_apart(node, n, bits, np.array(roots(linked)), marks)
    every = [(a, b) for a in range(len(texts)) for b in range(a) if near_copies.similarity(raw[a], raw[b]) >= 0.8]
    assert roots([*linked, *good(apart)]) == roots(every)
    assert good(apart) == list(zip(*(x.tolist() for x in apart)))  # with all marks, pairs are links
    assert len(first[0]) <= len(texts) * (near_copies.BEST + near_copies.PIVOTS + 1)
    # with a part of the marks more pairs come, and none is lost
    marks[:] = [m[: 64 + i % 90] for i, m in enumerate(marks)]
    fewer = near_copies.pairs_apart(node, n, bits, np.array(roots(linked)), marks)
    assert set(good(apart)) <= {p for a, b in zip(*(x.tolist() for x in fewer)) for p in ((a, b), (b, a))}


def test_a_long_run_on_spark(spark):
    """Over SMALL_RUN near copies, linked through their model alone, beside texts that share its passages and are no copies."""
    r = np.random.default_rng(7)
    model = [f"w{x}" for x in r.integers(0, 5000, 200)]
    texts = [model] + [altered(model, 60, r) for _ in range(60)] + [altered(model, 14, r) for _ in range(40)] + [[*model[:150], *altered(model[150:], 5, r)] for _ in range(5)]
    raw = [" ".join(t) for t in texts]
    root = list(range(len(raw)))
    alike = [(a, b) for a in range(len(raw)) for b in range(a) if near_copies.similarity(raw[a].encode(), raw[b].encode()) >= 0.8]
    for _ in raw:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in near_copies.one_of_each_group(docs).collect()) == sorted(set(root))
    assert 1 < len(set(root)) < len(raw)
