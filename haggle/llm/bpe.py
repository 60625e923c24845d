"""Byte-level BPE: exact encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token exactly one vocabulary entry can be the last token of the
prefix's encoding.  An automaton over the vocabulary lists the entries that end at each
position; the first of them that is compatible with the last token of the prefix before it is
kept, and following the entries backwards yields the ids.

Two neighbouring tokens are compatible when the merge process on their joined bytes never
merges across the seam.  The seam is watched bottom-up: on either side stands one piece of the
right spine of the left token and of the left spine of the right token, and each piece is
replaced by its parent when the parent's merge has its turn.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, small_batches

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

# The byte-level pre-token pattern, spelled for any text and for Latin-1 text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼-¾"

#: Entries of each of the two generations of a worker's pre-token memory.
MEMO = 150_000
#: Longer pre-tokens are not remembered, which bounds the memory in bytes too.
LONG_PIECE = 256


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """``compute`` remembered in two bounded generations; what is asked for again survives."""

    def __init__(self, compute, limit: int = MEMO):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(key) > LONG_PIECE:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBpe:
    """One vocabulary.  ``encode`` and ``decode`` are exact inverses of each other on any text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.bytes_of = {i: as_bytes[t] for t, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.plain_ids = dict(self.bytes_of)
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            l, r = self.id_of[as_bytes[left]], self.id_of[as_bytes[right]]
            self.rank[l, r] = rank
            whole = self.id_of[as_bytes[left] + as_bytes[right]]
            if whole not in self.made:
                self.made[whole] = (rank, l, r)
        self.result = {p: self.id_of[self.bytes_of[p[0]] + self.bytes_of[p[1]]] for p in self.rank}
        self.split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.any_text = regex.compile(PATTERN)
        import re

        self.latin = re.compile(
            PATTERN.replace(r"\p{L}+", f"[{LATIN_LETTERS}]+")
            .replace(r"\p{N}+", f"[{LATIN_NUMBERS}]+")
            .replace(r"[^\s\p{L}\p{N}]+", rf"[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+")
        )
        self.beyond_latin = re.compile("[^\x00-\xff]")
        self.automaton = ahocorasick.Automaton()
        for i, b in self.plain_ids.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.right = lru_cache(60_000)(lambda t: self._spine(t, 2))
        self.left = lru_cache(60_000)(lambda t: self._spine(t, 1))
        self.fits = lru_cache(200_000)(self._fits)
        self.memo = Memo(lambda p: ",".join(map(str, self.word_ids(p))))
        self.text_of = {str(i): b for i, b in self.bytes_of.items()}

    def _spine(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """From the outermost byte up to the token: each piece, with the rank that takes it up."""
        nodes, rank = [], float("inf")
        while True:
            nodes.append((token, rank))
            if token not in self.made:
                return tuple(reversed(nodes))
            rank, token = self.made[token][0], self.made[token][side]

    def _fits(self, a: int, b: int) -> bool:
        left, right = self.right(a), self.left(b)
        i = k = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[k]
            seam = self.rank.get((x, y))
            # Equal ranks: the left-most pair goes first, so a parent on the left beats the seam.
            if seam is not None and seam < x_until and seam <= y_until:
                return False
            if i == len(left) - 1 and k == len(right) - 1:
                return True
            if x_until <= y_until:
                i += 1
            else:
                k += 1

    def word_ids(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        raw = word.encode()
        whole = self.id_of.get(raw)
        if len(raw) == 1:
            return [whole]
        n, fits = len(raw), self.fits
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, entry in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] is None:
                start = end - entry[1]
                if start == 0 or (last[start] is not None and fits(last[start][0], entry[0])):
                    last[end] = entry
        ids, at = [], n
        while at:
            token, width = last[at]
            ids.append(token)
            at -= width
        ids.reverse()
        return ids

    def pieces(self, text: str) -> list[str]:
        pattern = self.any_text if self.beyond_latin.search(text) else self.latin
        return pattern.findall(text)

    def id_strings(self, text: str) -> list[str]:
        """The decimal ids of each pre-token, joined by commas."""
        get = self.memo.__getitem__
        if self.split_special is None or not any(s in text for s in self.special):
            return list(map(get, self.pieces(text)))
        out: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(str(self.special[part]))
            else:
                out += map(get, self.pieces(part))
        return out

    def encode(self, text: str) -> list[int]:
        joined = ",".join(self.id_strings(text))
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> ByteBpe:
    """One vocabulary per worker process."""
    return ByteBpe(path)


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``id_col, ids array<int>``.

    Null and empty texts have no ids; repeated rows are encoded each for itself; an empty table
    gives an empty table; other columns of ``docs`` are ignored.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        bpe = codec(path)
        return lambda b: {id_col: b.column(0), "ids": [bpe.encode(t.as_py() or "") for t in b.column(1)]}

    return map_arrow(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows ``id_col, text``; null ids decode to the empty text."""
    path = path or tokenizer_path()
    small_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def make():
        bpe = codec(path)
        return lambda b: {id_col: b.column(0), "text": [bpe.decode(t.as_py() or ()) for t in b.column(1)]}

    return map_arrow(encoded.select(id_col, ids_col), make, f"`{id_col}` {kind}, text string")


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every text in one pass: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    The ids of a text stay in the worker as decimal strings, which is the form that is hashed.
    Nulls, empty texts and repeated rows as in :func:`bpe_encode`.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        bpe = codec(path)
        back = bpe.text_of.__getitem__

        def one(text: str) -> tuple[int, str, str]:
            joined = ",".join(bpe.id_strings(text))
            ids = joined.split(",") if joined else []
            decoded = b"".join(map(back, ids)).decode("utf-8", "replace").encode()
            return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

        def step(batch):
            rows = [one(t.as_py() or "") for t in batch.column(1)]
            n, ids, decoded = zip(*rows)
            return {id_col: batch.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return step

    return map_arrow(
        docs.select(id_col, "text"),
        make,
        f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def bpe_corpus(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids``, and ``exact``: whether decoding the ids gives the text.

    Nulls, empty texts and repeated rows as in :func:`bpe_encode`; columns of those names are replaced.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "exact")]

    def run(batches):
        bpe = codec(path)
        back = bpe.text_of.__getitem__
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            ids, exact = [], []
            for text in texts:
                joined = ",".join(bpe.id_strings(text or ""))
                ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
                exact.append(b"".join(map(back, joined.split(","))).decode("utf-8", "replace") == text if joined else not text)
            n = [len(x) for x in ids]
            ends = np.cumsum([0, *n]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(n, pa.int64()), listed, pa.array(exact)], [*others, "n_tokens", "ids", "exact"]
            )

    chosen = docs.select(*(docs[c] for c in others), docs["text"])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return chosen.mapInArrow(run, f"{kinds}, n_tokens bigint, ids array<int>, exact boolean")
