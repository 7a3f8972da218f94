"""Licence scans: phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser (operator 6)."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, map_batches, whole_texts

# Phrases of whole words and the labels that they give.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MORE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
    "creative commons attribution noncommercial": "cc-by-nc",
}
# Identifiers of licence expressions (lower case) and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc0-1.0": "cc0",
    "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-2.0": "gpl-2", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-3.0": "gpl-3",
    "lgpl-2.1-only": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl", "agpl-3.0-only": "agpl-3", "agpl-3.0-or-later": "agpl-3",
    "mpl-2.0": "mpl-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib",
}
#: How free a use each label leaves: 1 for any use with notice, 0 for none.
FREEDOM = {"mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl-2": 0.7, "cc-by-sa": 0.6, "lgpl": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.2, "all-rights-reserved": 0.0}
TAG, TAG_WORDS = "spdx-license-identifier:", "spdx license identifier"
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Upper case to lower case, every ASCII byte that is in no word to a blank; bytes of longer code points stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str, start: int = 0, stop: int | None = None) -> list[str] | None:
    """Shunting yard: the expression in postfix order, `with` binding closest and `or` least; None if it is malformed.

    It is read from start on, token by token, to the second of two operands without an operator or to stop."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for found in _TOKEN.finditer(expression, start, len(expression) if stop is None else stop):
        token = found[0]
        word = token.lower()
        if word in _BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                break  # the expression ends where a second operand follows
            out.append(word)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str, start: int = 0, stop: int | None = None) -> tuple[set[str], float] | None:
    """The labels that an expression names and its freedom: `or` leaves the freer side, `and` the stricter, `with` an
    exception that keeps its licence's labels and loosens it a little. None if it is malformed or names nothing known."""
    order = postfix(expression, start, stop)
    if order is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append((a[0], min(1.0, a[1] + 0.1)) if token == "with" else (a[0] | b[0], (max if token == "or" else min)(a[1], b[1])))
        else:
            label = IDENTIFIERS.get(token.removesuffix("+"))
            stack.append(({label}, FREEDOM[label]) if label else (set(), 0.5))
    return stack[0] if stack[0][0] else None


def _automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*phrases, TAG_WORDS]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scanner():
    """A function from a text's bytes to (n_words, starts of base phrases, base labels, all labels, score)."""
    every = _automaton(BASE_PHRASES | MORE_PHRASES)

    def scan(text: bytes) -> tuple[int, list[int], set[str], set[str], float]:
        words = text.translate(_WORDS).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        places, base, labels, scores, tagged = [], set(), set(), [], False
        for end, phrase in every.iter(line):
            if phrase in BASE_PHRASES:
                places.append(end - len(phrase) - 1)
                base.add(BASE_PHRASES[phrase])
                labels.add(BASE_PHRASES[phrase])
            elif phrase == TAG_WORDS:
                tagged = True
            else:
                labels.add(MORE_PHRASES[phrase])
        starts = []
        if places:  # blanks before a place: the number of the word that begins there
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            starts = np.searchsorted(blanks, places).tolist()
        scores += [FREEDOM[x] for x in labels]
        if tagged:
            # a tag's expression ends with its line or at the next tag, so no stretch is read twice
            lower = text.lower().decode("latin-1")
            at = lower.find(TAG)
            while at >= 0:
                after = lower.find(TAG, at + 1)
                stop = lower.find("\n", at, after if after >= 0 else len(lower))
                got = evaluate(lower, at + len(TAG), stop if stop >= 0 else after if after >= 0 else len(lower))
                if got:
                    labels |= got[0]
                    scores.append(got[1])
                at = after
        return len(words), starts, base, labels, min(scores, default=0.0)

    return scan


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Words, base phrases (all places) and labels of each whole text.

    first_word and last_word are the least and greatest start of a base phrase, in words from 0; null without one.
    score is the freedom that the strictest notice leaves (0 without a notice). A null or empty text has no words and no
    labels (empty strings). Repeated rows give repeated results, an empty table none; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        scan = scanner()
        got = [scan(t) for t in byte_texts(batch["text"])]
        return {
            "doc_id": batch["doc_id"],
            "n_words": [g[0] for g in got],
            "n_base": [len(g[1]) for g in got],
            "first_word": [min(g[1], default=None) for g in got],
            "last_word": [max(g[1], default=None) for g in got],
            "base_labels": [",".join(sorted(g[2])) for g in got],
            "labels": [",".join(sorted(g[3])) for g in got],
            "score": [float(g[4]) for g in got],
        }

    return map_batches(whole_texts(docs), run, SCHEMA)
