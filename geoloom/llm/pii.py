"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions (operator 1)."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, map_batches, to_batch, whole_texts

KINDS = ("email", "ip", "card", "phone")
#: What the tagger finds: the kinds of the fixed patterns in forms that these miss too, and secrets (keys, tokens, passwords).
TAGGED = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in TAGGED for p in "BI"))
#: Windows of characters, half overlapping; a character's scores come from both windows, more from that of which it stands
#: nearer the middle.
WINDOW, HALF = 64, 32
HIDDEN = 16
#: Training: examples from whole texts of a bounded sample of documents, with their own spans and written forms of each kind.
SAMPLE_DOCS, EXAMPLES, EPOCHS, BATCH, RATE, SEED = 200, 2000, 6, 32, 0.02, 7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_LONG = re.compile(r"[A-Za-z0-9_/+-]{12,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, kind by kind, leftmost and without overlap; matches that fail their test drop out."""
    found: list[tuple[str, int, int]] = []
    if not _ANCHOR.search(text):
        return found
    last = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                last = m.end()
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


class _Classes(dict):
    """Character classes of the tagger's input."""

    MARKS = "@.-+() _%\n/:,;'\"[]="

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if "0" <= ch <= "9":
            n = 1
        elif "a" <= ch <= "z":
            n = 2
        elif "A" <= ch <= "Z":
            n = 3
        elif (at := self.MARKS.find(ch)) >= 0:
            n = 6 + at
        else:
            n = 4 if ch.isalpha() else 5
        self[c] = chr(n)
        return chr(n)


_CLASSES = _Classes()
N_CLASSES = 6 + len(_Classes.MARKS)


def classes(text: str) -> np.ndarray:
    return np.frombuffer(text.translate(_CLASSES).encode("latin-1"), np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Bidirectional LSTM over character classes, a linear layer, and a linear-chain CRF over the tags."""

    NAMES = ("xf", "hf", "bf", "xb", "hb", "bb", "out", "bias", "move")

    def __init__(self, seed: int = SEED) -> None:
        r, h, k = np.random.default_rng(seed), HIDDEN, len(TAGS)
        self.p = {n: r.normal(0, 0.2, s) for n, s in (("xf", (N_CLASSES, 4 * h)), ("hf", (h, 4 * h)), ("xb", (N_CLASSES, 4 * h)), ("hb", (h, 4 * h)), ("out", (2 * h, k)))}
        self.p |= {"bf": np.zeros(4 * h), "bb": np.zeros(4 * h), "bias": np.zeros(k), "move": np.zeros((k, k))}

    def _lstm(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: (time, batch) classes, in reading order."""
        wx, wh, b = (self.p[n + way] for n in "xhb")
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, tape = np.empty((*x.shape, HIDDEN)), []
        for t in range(len(x)):
            z = wx[x[t]] + h @ wh + b
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, held = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((i, f, o, g, tc, held, before))
        return out, tape

    def _lstm_back(self, x: np.ndarray, way: str, tape: list, dout: np.ndarray, grad: dict) -> None:
        wh = self.p["h" + way]
        dh = dc = np.zeros((x.shape[1], HIDDEN))
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, tc, held, before = tape[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * held * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            np.add.at(grad["x" + way], x[t], dz)
            grad["h" + way] += before.T @ dz
            grad["b" + way] += dz.sum(axis=0)
            dh, dc = dz @ wh.T, dc * f

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, tags) scores of windows given as (time, batch) classes."""
        f, _ = self._lstm(x, "f", False)
        b, _ = self._lstm(x[::-1], "b", False)
        return np.concatenate([f, b[::-1]], axis=2) @ self.p["out"] + self.p["bias"]

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag path of each stretch, given its (time, tags) scores: Viterbi over scores and transitions, from the
        first character of a stretch to its last. Stretches go side by side, the longest first."""
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
        move = self.p["move"]
        for a in range(0, len(order), 256):
            part = order[a : a + 256]
            sizes = np.array([len(emissions[i]) for i in part])
            best, back = np.stack([emissions[i][0] for i in part]), []
            for t in range(1, sizes[0]):
                n = int((sizes > t).sum())
                s = best[:n, :, None] + move
                back.append(s.argmax(axis=1).astype(np.int8))
                best[:n] = s.max(axis=1) + np.stack([emissions[i][t] for i in part[:n]])
            at = best.argmax(axis=1)
            paths = [np.empty(n, np.int64) for n in sizes]
            for t in range(sizes[0] - 1, -1, -1):
                n = int((sizes > t).sum())
                for k in range(n):
                    paths[k][t] = at[k]
                if t:
                    at[:n] = back[t - 1][np.arange(n), at[:n]]
            for i, path in zip(part, paths):
                out[i] = path
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """The mean loss of a batch (time, batch) and its gradients."""
        n = x.shape[1]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        f, tf = self._lstm(x, "f", True)
        b, tb = self._lstm(x[::-1], "b", True)
        both = np.concatenate([f, b[::-1]], axis=2)
        e, move = both @ self.p["out"] + self.p["bias"], self.p["move"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, len(e)):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - log_z[:, None])
        rows = np.arange(n)
        gold = 0.0
        for t in range(len(e)):
            gold += e[t, rows, y[t]].sum()
            de[t, rows, y[t]] -= 1
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - log_z[:, None, None])
                grad["move"] += pair.sum(axis=0) / n
                np.add.at(grad["move"], (y[t - 1], y[t]), -1 / n)
                gold += move[y[t - 1], y[t]].sum()
        de /= n
        grad["out"] = np.einsum("tbh,tbk->hk", both, de)
        grad["bias"] = de.sum(axis=(0, 1))
        d = de @ self.p["out"].T
        self._lstm_back(x, "f", tf, d[:, :, :HIDDEN], grad)
        self._lstm_back(x[::-1], "b", tb, d[::-1, :, HIDDEN:], grad)
        return float((log_z.sum() - gold) / n), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> float:
        """Adam over shuffled batches of labelled windows (window, time); the last epoch's mean loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t, mean = 0, 0.0
        for epoch in range(epochs):
            losses = []
            order = r.permutation(len(x))
            for a in range(0, len(x), BATCH):
                at = order[a : a + BATCH]
                loss, grad = self.step(x[at].T, y[at].T)
                losses.append(loss)
                t += 1
                norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
                for k, g in grad.items():
                    g *= min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    self.p[k] -= RATE / (1 + epoch / 2) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            mean = float(np.mean(losses))
        return mean


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def written(kind: str, r: np.random.Generator) -> str:
    """A written form of a kind, those included that the fixed patterns miss."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda n: "".join(chr(97 + i) for i in r.integers(0, 26, n))
    pick = lambda *x: x[int(r.integers(len(x)))]
    if kind == "secret":
        key = "".join("0123456789abcdef"[i] for i in r.integers(0, 16, int(pick(24, 32, 40, 40, 64))))
        free = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[i] for i in r.integers(0, 62, int(pick(16, 20, 28, 36))))
        return pick(key, key, key.upper(), free, "AKIA" + free.upper()[:16], "ghp_" + free)
    if kind == "email":
        at = pick("@", "@", "@", " @ ", "(@)", "[@]")
        return f"{word(int(r.integers(3, 9)))}{pick('', '.', '_')}{pick(d(2), word(4))}{at}{word(5)}{pick('', d(1))}.{pick('com', 'org', 'net', 'de', 'example.com')}"
    if kind == "ip":
        sep = pick(".", ".", ".", " . ", "[.]")
        return sep.join(str(x) for x in r.integers(1, 256, 4))
    if kind == "card":
        sep = pick("", "", "-", " ", ".")
        return pick("4", "5", "3", "6") + d(3) + sep + d(4) + sep + d(4) + sep + d(4)
    area = d(3)
    return pick(f"+{pick('1', '44', '49', '33')} ({area}) {d(3)}-{d(4)}", f"+{pick('1', '44', '49')} {area} {d(3)} {d(4)}", f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"00{pick('44', '49')} {area} {d(6)}", f"0{d(3)} {d(7)}")


def before_secret(r: np.random.Generator) -> tuple[str, str]:
    """What stands before and behind a secret."""
    name = ("token", "api_key", "password", "secret", "key", "auth")[int(r.integers(6))]
    name = name.upper() if r.random() < 0.2 else name
    return ((f'{name} = "', '"'), (f"{name}={chr(39)}", "'"), (f"{name}: ", ""), (f"{name}=", ""))[int(r.integers(4)) if r.random() < 0.6 else 0]


def other_number(r: np.random.Generator) -> str:
    """Numbers and marks that are nobody's: versions, years, prices, handles."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = "".join(chr(97 + i) for i in r.integers(0, 26, int(r.integers(3, 14))))
    forms = (f"Version {d(1)}.{d(1)}.", f"version {d(1)}.", f"in {d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"${d(3)}.{d(2)}", f"@{word[:6]}", f"{d(2)}%", f"{d(1)},{d(3)},{d(3)}", f"no. {d(5)}", f"{d(2)}:{d(2)}", f"{word}{d(1)}", f'{word} = "{word}"', f"{d(6)}")
    return forms[int(r.integers(len(forms)))]


def _own_piece(texts: list[str], spans: list[list[tuple[str, int, int]]], r: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]] | None:
    """A piece of a real text with the spans in it, half of the time one around a span; None where it would cut a span or
    holds a long run of letters and digits of which it isn't known what it is."""
    i = int(r.integers(len(texts)))
    text, found = texts[i], spans[i]
    size = int(r.integers(3, 60))
    at = int(r.integers(max(1, len(text) - size)))
    if found and r.random() < 0.5:
        _, s, e = found[int(r.integers(len(found)))]
        at, size = max(0, s - int(r.integers(20))), e - s + 30
    inside = [(k, s - at, e - at) for k, s, e in found if at <= s and e <= at + size]
    if any(s < at + size and e > at for _, s, e in found if not (at <= s and e <= at + size)):
        return None
    piece = text[at : at + size]
    if any(re.search("[0-9]", m[0]) and not any(s <= m.start() < e for _, s, e in inside) for m in _LONG.finditer(piece)):
        return None
    return piece, inside


def labelled(backgrounds: list[str], count: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, list[tuple[str, list[tuple[str, int, int]]]]]:
    """Labelled windows: classes and tags (window, time), and the texts with their spans. Pieces of real texts keep the spans
    of the fixed patterns; written forms of each kind, and numbers that are none, stand between them."""
    r = np.random.default_rng(seed)
    backgrounds = [b for b in backgrounds if b.strip()] or ["the of and to in is that it for was on are"]
    own = [sorted(base_spans(b), key=lambda x: x[1]) for b in backgrounds]
    xs, ys, texts = [], [], []
    for _ in range(count):
        text, spans = "", []
        while len(text) < WINDOW + 8:
            piece = _own_piece(backgrounds, own, r)
            if piece:
                spans += [(k, s + len(text), e + len(text)) for k, s, e in piece[1]]
                text += piece[0] + " "
            kind = TAGGED[int(r.integers(len(TAGGED)))]
            if r.random() < 0.6:
                lead, tail = before_secret(r) if kind == "secret" else ("", "")
                form = written(kind, r)
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(form)))
                text += lead + form + tail
            else:
                text += other_number(r)
            text += " " if r.random() < 0.8 else (". ", ", ", "\n", "!! ", "%%% ", "### ", ".")[int(r.integers(7))]
        shift = int(r.integers(0, max(1, len(text) - WINDOW + 1)))
        tags = np.zeros(len(text), np.int64)
        for kind, a, z in spans:
            tags[a:z] = 2 + 2 * TAGGED.index(kind)
            tags[a] = 1 + 2 * TAGGED.index(kind)
        xs.append(classes(text)[shift : shift + WINDOW])
        ys.append(tags[shift : shift + WINDOW])
        texts.append((text, spans))
    return np.array(xs), np.array(ys), texts


def train(backgrounds: list[str]) -> Tagger:
    tagger = Tagger()
    x, y, _ = labelled(backgrounds)
    tagger.fit(x, y)
    tagger.p = {k: v.astype(np.float32) for k, v in tagger.p.items()}
    return tagger


#: How much a window says of each of its characters.
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def model_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in whole texts.

    Windows tile a text, half overlapping. Where windows overlap their scores are averaged, and each stretch of adjoining
    windows is decoded once, from its first character to its last, so a span may cross any number of windows. A span must
    hold a digit or an at sign; where no window of a stretch has one, the characters are outside.
    """
    blank = 6 + _Classes.MARKS.index("\n")
    chars, chosen, stretches = {}, [], []
    for i, text in enumerate(texts):
        near = sorted({(m.start() + HALF // 2) // HALF + k for m in _ANCHOR.finditer(text) for k in (-2, -1, 0, 1)})
        near = [w for w in near if w >= 0 and w * HALF < len(text) + HALF]
        if near:
            chars[i] = np.concatenate([np.full(WINDOW, blank, np.uint8), classes(text), np.full(2 * WINDOW, blank, np.uint8)])
        for w in near:
            if chosen and chosen[-1][:2] == (i, w - 1):
                stretches[-1][2] += 1
            else:
                stretches.append([i, w, 1])
            chosen.append((i, w, len(stretches) - 1))
    if not chosen:
        return [[] for _ in texts]
    # window w covers the text from w * HALF - HALF // 2 on
    summed = [np.zeros(((n + 1) * HALF, len(TAGS)), np.float32) for _, _, n in stretches]
    weights = [np.zeros(((n + 1) * HALF, 1), np.float32) for _, _, n in stretches]
    for a in range(0, len(chosen), 512):
        part = chosen[a : a + 512]
        x = np.stack([chars[i][w * HALF - HALF // 2 + WINDOW :][:WINDOW] for i, w, _ in part], axis=1)
        got = tagger.emissions(x).astype(np.float32) * _WEIGHT[:, None]
        for k, (_, w, s) in enumerate(part):
            at = (w - stretches[s][1]) * HALF
            summed[s][at : at + WINDOW] += got[:, k]
            weights[s][at : at + WINDOW] += _WEIGHT
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, w, _), t in zip(stretches, tagger.decode([x / y for x, y in zip(summed, weights)])):
        kind = (t + 1) // 2
        start = w * HALF - HALF // 2
        for s in np.flatnonzero((kind > 0) & ((np.diff(kind, prepend=0) != 0) | (t % 2 == 1))).tolist():
            e = s + 1
            while e < len(t) and kind[e] == kind[s] and t[e] % 2 == 0:
                e += 1
            if 0 <= start + s < len(texts[i]):
                out[i].append((TAGGED[kind[s] - 1], start + s, min(start + e, len(texts[i]))))
    return out


def plausible(kind: str, s: str) -> bool:
    """What a found span must have to be reported."""
    d = digits_of(s)
    if kind == "secret":
        return len(s) >= 12 and bool(d) and re.search(r"[A-Za-z]", s) is not None and _LONG.fullmatch(s) is not None
    if kind == "email":
        return "@" in s and "." in s[s.index("@") :] and not s.startswith("@")
    if kind == "ip":
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and len(s) <= len(d) + 8 and luhn(d) and not re.search(r"[A-Za-z]", s)
    return 7 <= len(d) <= 15 and len(s) <= 2 * len(d) and not re.search(r"[A-Za-z]", s)


def trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """Grow a span of numbers to whole numbers and cut marks off its ends."""
    edge = re.compile({"email": r"[A-Za-z0-9]", "secret": r"[A-Za-z0-9_]"}.get(kind, r"[0-9]"))
    while start > 0 and edge.match(text[start - 1]) and edge.match(text[start]):
        start -= 1
    while end < len(text) and edge.match(text[end]) and edge.match(text[end - 1]):
        end += 1
    while start < end and not (edge.match(text[start]) or kind == "phone" and text[start] in "+("):
        start += 1
    while end > start and not edge.match(text[end - 1]):
        end -= 1
    return start, end


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """For each text the base spans, and all spans: the base ones and those of the tagger that overlap none before."""
    out = []
    for text, found in zip(texts, model_spans(texts, tagger)):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        more = []
        for kind, s, e in found:
            s, e = trimmed(kind, text, s, e)
            if s < e and plausible(kind, text[s:e]) and not any(a < e and s < z for a, z in taken):
                more.append((kind, s, e))
                taken.append((s, e))
        out.append((base, sorted(base + more, key=lambda x: (TAGGED.index(x[0]), x[1]))))
    return out


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def fitted(docs: DataFrame) -> Tagger:
    """A tagger whose examples stand in whole texts of a bounded sample: SAMPLE_DOCS documents, the smallest by a hash of
    doc_id, and of one id by a hash of the text.

    The ids are chosen first, so that every task sends at most SAMPLE_DOCS ids, and texts come of the chosen ones alone. One
    task trains, and the weights alone reach the driver.
    """
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(*order).limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(*order, F.xxhash64("text"), "text").limit(SAMPLE_DOCS)
    schema = "name string, shape array<int>, weights binary"
    arrow = arrow_schema(docs, schema)

    def run(batches):
        tagger = train([t for b in batches for t in b["text"].to_pylist()])
        yield to_batch({"name": list(tagger.p), "shape": [list(v.shape) for v in tagger.p.values()], "weights": [v.tobytes() for v in tagger.p.values()]}, arrow)

    tagger = Tagger()
    tagger.p = {r["name"]: np.frombuffer(r["weights"], np.float32).reshape(r["shape"]) for r in sample.select("text").coalesce(1).mapInArrow(run, schema).collect()} or tagger.p
    return tagger


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (kind:start:end in that order), spans (all, secrets last),
    n_secret and n_spans (of all).

    Positions are code points, ends exclusive. A null or empty text has no spans (empty strings). Repeated rows give
    repeated results, an empty table none; other columns are ignored. Long texts are tagged whole, window by window.
    """
    src = whole_texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(src))
    counts = ", ".join(f"n_{k} long" for k in KINDS)

    def run(batch) -> dict:
        texts = batch["text"].to_pylist()
        got = [x for a, z in chunks(texts) for x in all_spans(texts[a:z], shared.value)]
        out = {"doc_id": batch["doc_id"], "base": [said(b) for b, _ in got], "spans": [said(a) for _, a in got]} | {f"n_{k}": [sum(x[0] == k for x in b) for b, _ in got] for k in KINDS}
        return out | {"n_secret": [sum(x[0] == "secret" for x in a) for _, a in got], "n_spans": [len(a) for _, a in got]}

    return map_batches(src, run, f"doc_id long, {counts}, base string, spans string, n_secret long, n_spans long")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """find_spans() with the base spans as a digest, base_sha256."""
    found = find_spans(docs)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_secret", "n_spans")
