"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table (operator 2)."""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_texts, chunks, map_batches, whole_texts

#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces and token pairs that a worker remembers; then it starts anew.
MOST_PIECES, MOST_PAIRS, LONGEST_PIECE = 250_000, 1_000_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


class Vocabulary:
    """The tokens of a vocabulary file, with the matcher, the pair-compatibility table and the offset table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {raw(s): i for s, i in file["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        pieces = ids | self.special
        self.size = max(pieces.values()) + 1
        self.tokens = [b""] * self.size
        for s, i in pieces.items():
            self.tokens[i] = s
        self.split = [(i, i) for i in range(self.size)]
        self.rank = list(range(self.size))
        self.merged: dict[tuple[int, int], int] = {}
        base = self.size
        for r, m in enumerate(file["model"]["merges"]):
            a, b = (raw(s) for s in (m if isinstance(m, list) else m.split(" ")))
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged[left, right] = whole
            self.split[whole] = (left, right)
            self.rank[whole] = base + r
        self.ids = ids
        self.matcher = ahocorasick.Automaton()
        for s in ids:
            self.matcher.add_word(s.decode("latin-1"), len(s))
        self.matcher.make_automaton()
        self.sizes = [len(t) for t in self.tokens]
        self.shorter = self._shorter_prefixes()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.offsets = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s.decode()) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces = _Pieces(self)

    def _shorter_prefixes(self) -> list[int]:
        """For each token the longest other token that it begins with, or -1."""
        found = [-1] * self.size
        for s, i in self.ids.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := self.ids.get(s[:n])) is not None:
                    found[i] = j
                    break
        return found

    def fits(self, left: int, right: int) -> bool:
        """The pair-compatibility table: whether merging the two tokens' bytes in order leaves exactly these two.

        Both tokens are unmerged from the last merge backwards; the pair is out if a pair across the seam would have been
        merged before. Entries are worked out when first asked for.
        """
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= MOST_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        a, b, limit = left, right, 1 << 60
        while True:
            across = self.merged.get((a, b))
            if across is not None and self.rank[across] < limit:
                return False
            first, second = self.split[a][0] != a, self.split[b][0] != b
            if not first and not second:
                return True
            if first and (not second or self.rank[a] > self.rank[b]):
                limit, a = self.rank[a], self.split[a][1]
            else:
                limit, b = self.rank[b] + 1, self.split[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The exact merges of one piece, in time linear in its length."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        longest = [1] * len(piece)
        for end, n in self.matcher.iter(piece.decode("latin-1")):
            longest[end - n + 1] = n  # later ends are longer
        ids, sizes, shorter, fits, table = self.ids, self.sizes, self.shorter, self.fits, self.compatible
        stop, at, out, dead, last = len(piece), 0, [], set(), -1
        token = ids[piece[: longest[0]]]
        while at < stop:
            end = at + sizes[token]
            if end not in dead and (last < 0 or (known if (known := table.get((last, token))) is not None else fits(last, token))):
                out.append(token)
                at, last = end, token
                if at < stop:
                    token = ids[piece[at : at + longest[at]]]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> tuple[str, bytes]:
        """The ids of a text, as decimals joined by commas and as packed 32-bit integers."""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        decimals, packed = [], []
        for i, part in enumerate(parts):
            if i % 2:
                known = self.special[part.encode()]
                decimals.append(str(known))
                packed.append(np.int32(known).tobytes())
            elif part:
                made = list(map(self.pieces.__getitem__, PATTERN.findall(part)))
                decimals.append(",".join([m[0] for m in made]))
                packed.extend([m[1] for m in made])
        return ",".join(decimals), b"".join(packed)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of tokens, and where each token's bytes end: one gather by the offset table."""
        starts = self.offsets[ids]
        ends = np.cumsum(self.offsets[ids + 1] - starts)
        sizes = np.diff(ends, prepend=0)
        at = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.blob[at].tobytes(), ends


class _Pieces(dict):
    """Piece -> its ids as decimals joined by commas and as packed integers; bounded, long pieces are not kept."""

    def __init__(self, owner: Vocabulary) -> None:
        super().__init__()
        self.owner, self.older = owner, {}

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        made = self.older.get(piece) or self._made(piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.older = dict(self)  # what was used since the last change of generation stays at hand
                self.clear()
            self[piece] = made
        return made

    def _made(self, piece: str) -> tuple[str, bytes]:
        ids = self.owner.encode_piece(piece.encode())
        return ",".join(map(str, ids)), struct.pack(f"={len(ids)}i", *ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of each whole text; a null or empty text has none.

    Special tokens of the vocabulary that stand in a text become their own ids. Repeated rows give repeated results, an
    empty table none; other columns are ignored.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        packed = [v.encode(t)[1] for t in batch["text"].to_pylist()]
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return {"doc_id": batch["doc_id"], "n_tokens": np.diff(offsets).astype(np.int64), "ids": ids}

    return map_batches(whole_texts(docs), run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids (null ids: empty)."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        texts = [v.decode(np.array(x or [], np.int64))[0].decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
        return {"doc_id": batch["doc_id"], "text": texts}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text and decode the ids again, keeping digests of both: what encode() and decode() give, with
    the ids staying in the task that made them. Returns doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    path = path or default_path()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batch: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        raw = byte_texts(batch["text"])
        for a, b in chunks(raw):
            packed = []
            for t in raw[a:b]:
                decimals, ints = v.encode(t.decode())
                packed.append(ints)
                out["n_tokens"].append(len(ints) // 4)
                out["ids_sha256"].append(sha(decimals.encode()))
            text, ends = v.decode(np.frombuffer(b"".join(packed), np.int32))
            start = last = 0
            for p in packed:
                last += len(p) // 4
                end = int(ends[last - 1]) if last else 0
                out["decoded_sha256"].append(sha(text[start:end]))
                start = end
        return out

    return map_batches(whole_texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
