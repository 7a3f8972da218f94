"""Operators that look at one document at a time, against brute force."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from geoloom.llm import bpe, license_scan, pii, quality_rules
from .conftest import edge_rows, prose

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# operator 1

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_match_brute_force():
    rnd = random.Random(5)
    pieces = ["@", ".", "-", " ", "+", "1", "12", "255", "256", "4111111111111111", "a", "b.c", "(", ")", "é", "@a.b", "10.0.0.1", "+49 30 123456", "\n", "4111-1111 1111 1111"]
    for _ in range(4000):
        text = "".join(rnd.choices(pieces, k=rnd.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.fixture(scope="module")
def tagger():
    return pii.train([prose(60, s) for s in range(40)])


def test_tagger_on_held_out_spans(tagger):
    _, _, texts = pii.labelled([prose(50, 100 + s) for s in range(20)], 300, seed=99)
    right = found = held = 0
    for (text, spans), (_, got) in zip(texts, pii.all_spans([t for t, _ in texts], tagger)):
        want = {s for s in spans if s[0] != "card" or pii.luhn(pii.digits_of(text[s[1] : s[2]]))}
        right, found, held = right + len(want & set(got)), found + len(got), held + len(want)
    assert right / found > 0.9 and right / held > 0.9


def test_tagger_adds_what_the_patterns_miss(tagger):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for n in range(0, 70, 7):  # wherever the windows fall
        text = prose(n) + f' token = "{key}" ' + prose(9)
        assert pii.all_spans([text], tagger) == [([], [("secret", text.index(key), text.index(key) + 40)])]


def test_stretches_are_decoded_as_wholes():
    t, r = pii.Tagger(), np.random.default_rng(3)
    t.p["move"] = r.normal(0, 1, t.p["move"].shape)
    scores = [r.normal(0, 1, (n, len(pii.TAGS))) for n in (4, 1, 3)]
    for e, path in zip(scores, t.decode(scores)):
        total = lambda p: sum(e[i, k] for i, k in enumerate(p)) + sum(t.p["move"][a, b] for a, b in zip(p, p[1:]))
        assert total(path) == pytest.approx(max(total(p) for p in itertools.product(range(len(pii.TAGS)), repeat=len(e))))


def test_tagger_gradients():
    t, eps = pii.Tagger(), 1e-5
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.N_CLASSES, (5, 3)), r.integers(0, len(pii.TAGS), (5, 3))
    _, grad = t.step(x, y)
    for name in t.NAMES:
        at = tuple(r.integers(0, n) for n in t.p[name].shape)
        old = t.p[name][at]
        t.p[name][at] = old + eps
        up = t.step(x, y)[0]
        t.p[name][at] = old - eps
        down = t.step(x, y)[0]
        t.p[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(grad[name][at], abs=1e-4)


def test_spans_across_windows_and_clean_texts(tagger):
    mail = "someone.with.a.long.name@mail4.example.com"
    texts = [prose(n) + " " + mail + " " + prose(20) for n in range(3, 40, 3)]
    for text, (base, every) in zip(texts, pii.all_spans(texts, tagger)):
        assert base == every == [("email", text.index(mail), text.index(mail) + len(mail))]
    assert all(a == [] for _, a in pii.all_spans([prose(500, s) for s in range(5)] + ["", "no digits"], tagger))


def test_personal_data_query(edge_docs, no_docs):
    got = pii.find_personal_data(edge_docs).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        text = {row[0]: row[1] or "" for row in edge_rows()}[r["doc_id"]]
        assert r["base_sha256"] == sha(pii.said(brute_spans(text)))
        assert set(pii.said(brute_spans(text)).split(",")) <= set(r["spans"].split(",")) and r["n_spans"] == len(list(filter(None, r["spans"].split(","))))
    assert pii.find_personal_data(no_docs).collect() == []


# operator 2


def test_encoding_equals_the_library(edge_docs, no_docs):
    from tokenizers import Tokenizer

    library, v = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path())
    rnd = random.Random(1)
    alphabet = [chr(c) for c in range(0x250)] + ["<|endoftext|>", "'s", "'ll", " ", "  ", "\u0085", "日", "\U0001f600", "½", "\n", "the", "tion"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, " " * 500 + "x", "ab" * 700, *[r[1] or "" for r in edge_rows()]]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        decimals, packed = v.encode(text)
        assert decimals == ",".join(map(str, ids))
        assert v.decode(np.frombuffer(packed, np.int32))[0].decode() == library.decode(ids, skip_special_tokens=False)
    for r in bpe.round_trip(edge_docs).collect():
        text = {row[0]: row[1] or "" for row in edge_rows()}[r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(edge_docs)).collect()}
    assert back[14] == edge_rows()[14][1] and back[0] == ""
    assert bpe.round_trip(no_docs).collect() == []


def test_every_token_is_its_own_encoding():
    v = bpe.vocabulary(bpe.default_path())
    for i in range(0, 50_000, 37):
        assert v.encode_piece(v.tokens[i]) == [i]


# operator 6


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_query(edge_docs, no_docs):
    for r in license_scan.scan_licenses(edge_docs).collect():
        text = {row[0]: row[1] or "" for row in edge_rows()}[r["doc_id"]]
        assert tuple(r)[1:6] == brute_license(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = by_id(license_scan.scan_licenses(edge_docs))[13]
    assert got["labels"] == "apache-2,cc-by-nc,gpl-3,mit" and got["score"] == pytest.approx(0.2)
    assert license_scan.scan_licenses(no_docs).collect() == []


def test_random_phrases():
    rnd, scan = random.Random(2), license_scan.scanner()
    pieces = "under the mit license apache version 2 cc by nc é 20 Under THE x".split()
    for _ in range(3000):
        text = rnd.choice([" ", ", ", "\n"]).join(rnd.choices(pieces, k=rnd.randint(0, 14)))
        n, starts, base, _, _ = scan(text.encode())
        assert (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base))) == brute_license(text)


def test_long_texts_take_linear_time():
    scan = license_scan.scanner()
    tags, phrases = "SPDX-License-Identifier: MIT OR ISC and more " * 23_000, "cc by nc " * 115_000
    began = time.perf_counter()
    n, starts, base, labels, score = scan(phrases.encode())
    assert (n, starts[:2], starts[-1], len(starts), base) == (345_000, [0, 3], 344_997, 115_000, {"cc-by-nc"})
    assert scan(tags.encode())[3:] == ({"mit", "isc"}, 1.0)
    assert time.perf_counter() - began < 4
    assert scan(b"SPDX-License-Identifier: (MIT OR\nSPDX-License-Identifier: GPL-3.0 SPDX-License-Identifier: ISC")[3] == {"gpl-3", "isc"}


def test_expressions():
    e = license_scan.evaluate
    assert license_scan.postfix("MIT OR GPL-2.0 AND ISC WITH x") == ["mit", "gpl-2.0", "isc", "x", "with", "and", "or"]
    assert e("MIT OR GPL-3.0-only") == ({"mit", "gpl-3"}, 1.0) and e("MIT AND GPL-3.0-only") == ({"mit", "gpl-3"}, 0.4)
    assert e("(MIT OR GPL-3.0-only) AND CC-BY-NC-4.0")[1] == 0.2 and e("GPL-2.0+ WITH Classpath-exception-2.0") == ({"gpl-2"}, 0.5)
    assert all(e(x) is None for x in ("", "MIT OR", "(MIT", "MIT)", "AND MIT", "unheard-of"))


# operator 8


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_rules(edge_docs, no_docs):
    for r in quality_rules.quality_rules(edge_docs).collect():
        want = brute_rules({row[0]: row[1] or "" for row in edge_rows()}[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(no_docs).collect() == []


def test_repeated_words_in_random_lists():
    rnd = random.Random(4)
    lists = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 40))] for _ in range(300)]
    assert quality_rules.repeated_words(lists) == [brute_rules(b" ".join(x).decode())[4] for x in lists]


def brute_grams(text):
    w = " ".join(text.split()).encode()
    padded = b"\n" * 4 + w + b" "
    return [padded[i : i + 5] for i in range(len(w) + 1)] if w else []


def brute_model(texts):
    """p(last byte | the bytes before) of every gram in the texts, and that of grams seen once as if they weren't, by
    dictionaries and recursion."""
    levels = {5: Counter(g for t in texts for g in brute_grams(t))}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, level in levels.items():
        n = [sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        cuts[k] = [max(0.05, min(0.9 * i, i - (i + 1) * y * n[i] / max(n[i - 1], 1))) for i in (1, 2, 3)]

    def p(g, held=False):
        if not g:
            return 1 / 256
        k = len(g)
        same = [c for x, c in levels[k].items() if x[:-1] == g[:-1]]
        cut = [cuts[k][min(c, 3) - 1] for c in same]
        own = 0 if held and k == 5 and levels[k][g] == 1 else levels[k][g] - cuts[k][min(levels[k][g], 3) - 1]
        return (own + sum(cut) * p(g[1:])) / sum(same)

    return {g: p(g) for g in levels[5]}, {g: p(g, True) for g in levels[5]}


def test_model_equals_brute_force(spark, monkeypatch):
    texts = [prose(12, s) for s in range(6)] + ["é日 x  y\tz", "", "a"]
    docs = spark.createDataFrame([(i, t, "en-GB" if i % 2 else "EN") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    want, held = brute_model(texts)
    got = quality_rules.kneser_ney(quality_rules.gram_counts(docs.select(quality_rules.language(docs["lang"]).alias("lang"), "text"))).collect()
    assert {r["lang"] for r in got} == {"en"} and {r["gram"].to_bytes(5, "big"): r["p"] for r in got} == pytest.approx(want)
    letters = lambda t: sum(b >= 128 or chr(b).isalnum() for b in t.encode())
    log = {i: sum(-np.log(held[g]) for g in brute_grams(t)) / letters(t) for i, t in enumerate(texts) if t}
    for most in (1 << 18, 40, 0):  # whatever stands in the broadcast head, the perplexities are the same
        monkeypatch.setattr(quality_rules, "HEAD_GRAMS", most)
        rows = quality_rules.quality_rules(docs).collect()
        assert {r["doc_id"]: np.log(r["perplexity"]) for r in rows if r["perplexity"]} == pytest.approx(log, rel=1e-4)


def noise(rnd, n=150):
    return " ".join("".join(rnd.choices("the er ing tion an on ed sh ble rea".split(), k=rnd.randint(1, 3))) for _ in range(n))


def test_bands_reject_both_sides_of_each_language(spark):
    rnd = random.Random(1)
    rows = [(i, noise(rnd), "en") for i in range(200)] + [(300 + i, "".join(rnd.choices("xqzjkvw8日Ж", k=9)) + " " + noise(rnd), "fr") for i in range(3)]
    junk = " ".join("".join(rnd.choices("xqzjkvw8日Ж%", k=9)) for _ in range(150))
    marked = " ".join(w + rnd.choice(["***", "###", "$$$"]) for w in noise(rnd).split())
    # different words all along, of which most bytes are foretold
    dull = " ".join("theeringtionanonedshblereatheeringtionanonedshblerea" * 3 + x for x in "a b c d e f g h i j k l m n o p q r s t".split())
    rows += [(998, marked, "en"), (999, junk, "en"), (997, dull, "en"), (996, junk, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality_rules.quality_rules(docs).where("not kept").collect()} == {997, 998, 999}


def test_rows_are_judged_by_their_own_text(spark):
    rnd = random.Random(2)
    good, bad = noise(rnd), "few words"
    rows = [(i, noise(rnd), "en") for i in range(40)] + [(None, good, "en"), (None, bad, "en"), (7, bad, "en"), (8, None, "en"), (50, good, "en"), (50, good, "en")]
    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows if r[1] not in (bad, None)], key=str)
