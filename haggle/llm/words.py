"""Hashes of words and word shingles, made in whole-array steps.

Words are what stands between the white-space bytes 09-0D and 20, after A-Z became a-z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .common import PIECE_BYTES

U = np.uint64
GOLDEN, MIX_1, MIX_2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # splitmix64
BASE = U(0xD6E8FEB86659FD93)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Words longer than this are hashed one by one.
LONG_WORD = 4096
END = U(0x1D8E4E27C47D124F)  # the end token
START = U(0xA24BAED4963EE407)  # the context of a text's first token

TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * MIX_1
        x = (x ^ (x >> U(27))) * MIX_2
        return x ^ (x >> U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a lower-cased buffer."""
    a = np.frombuffer(buffer, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = a != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.get(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODES[a] * up[: len(a)], out=sums[1:])
        length = (ends - starts).astype(np.uint64)
        h = mix((sums[ends] - sums[starts]) * down[starts] + length * GOLDEN)
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, starts


def _cut_points(raw: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut where white space stands."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        # A cut stands on a space, which the next part begins with: look behind it.
        end = raw.rfind(b" ", at + 1, at + PIECE_BYTES)
        if end < 0:
            end = raw.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def hash_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and how many each text has."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    size = first = 0

    def flush(upto: int) -> None:
        nonlocal held, size, first
        if held:
            h, starts = _hash_buffer(b" ".join(held))
            offsets = np.cumsum([0] + [len(x) + 1 for x in held])
            counts[first:upto] = np.diff(np.searchsorted(starts, offsets))
            hashes.append(h)
        held, size, first = [], 0, upto

    for i, text in enumerate(texts):
        raw = (text or "").encode().translate(TO_LOWER)
        if len(raw) > PIECE_BYTES:
            flush(i)
            for part in _cut_points(raw):
                h, _ = _hash_buffer(part)
                hashes.append(h)
                counts[i] += len(h)
            first = i + 1
            continue
        held.append(raw)
        size += len(raw)
        if size >= PIECE_BYTES:
            flush(i + 1)
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text after text, and how many each text has.

    A text of fewer words has one shingle of all its words, and none if it has no words.
    """
    words, n = hash_texts(texts)
    per_text = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), per_text)
    starts = np.cumsum(n) - n
    inner = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = starts[owner] + inner
    last = (starts + n)[owner]
    h = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            at = first + k
            inside = at < last
            word = words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.zeros(len(at), np.uint64)
            h = np.where(inside, mix(h * BASE + word + U(k + 1)), h)
    return h, per_text
