"""Token counts with a whole-token shortcut.

Offline, before any task starts, every vocabulary string is run through the merges once; those that
come out as the one token they are form the proven set, which is sent to the workers (the vocabulary
bounds it).  A pre-token of that set counts one without any merging; the rest are merged with a
priority queue.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import ByteBpe, Memo, codec, tokenizer_path
from .common import map_arrow, small_batches


def merge_count(bpe: ByteBpe, raw: bytes) -> int:
    """Tokens left after merging ``raw``: lowest rank first, the left-most first among equals."""
    ids: list[int | None] = [bpe.id_of[bytes([b])] for b in raw]
    n = len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank, result = bpe.rank, bpe.result
    queue = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
    heapq.heapify(queue)
    left = n
    while queue:
        _, i, pair = heapq.heappop(queue)
        k = after[i] if i < n else n
        if ids[i] != pair[0] or k >= n or ids[k] != pair[1]:
            continue
        ids[i], ids[k] = result[pair], None
        after[i] = after[k]
        left -= 1
        if after[i] < n:
            before[after[i]] = i
            p = (ids[i], ids[after[i]])
            if p in rank:
                heapq.heappush(queue, (rank[p], i, p))
        if before[i] >= 0:
            p = (ids[before[i]], ids[i])
            if p in rank:
                heapq.heappush(queue, (rank[p], before[i], p))
    return left


@lru_cache(4)
def proven(path: str) -> frozenset[bytes]:
    """The vocabulary strings that alone encode as one token."""
    bpe = codec(path)
    return frozenset(b for b in bpe.plain_ids.values() if merge_count(bpe, b) == 1)


class Counter:
    """Counts the tokens of a text with the proven set of its vocabulary."""

    def __init__(self, path: str, proven: frozenset[bytes]):
        self.bpe, self.proven = codec(path), proven
        self.memo = Memo(self._word)

    def _word(self, word: str) -> int:
        raw = word.encode()
        return 1 if raw in self.proven else merge_count(self.bpe, raw)

    def count(self, text: str) -> int:
        bpe, get = self.bpe, self.memo.__getitem__
        if bpe.split_special is None or not any(s in text for s in bpe.special):
            return sum(map(get, bpe.pieces(text)))
        return sum(
            1 if part in bpe.special else sum(map(get, bpe.pieces(part))) for part in bpe.split_special.split(text)
        )


_counters: dict[str, Counter] = {}


def counter(path: str, known: frozenset[bytes]) -> Counter:
    """One counter per worker process, so that its memory outlives a task."""
    if path not in _counters:
        _counters[path] = Counter(path, known)
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Rows ``id_col, n_bytes, n_tokens, over_limit``.

    Null and empty texts count zero; repeated rows count each for itself; an empty table gives an
    empty table; other columns are ignored.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    sent = docs.sparkSession.sparkContext.broadcast(proven(path))

    def make():
        count = counter(path, sent.value).count

        def step(batch):
            n, size = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n.append(count(text))
                size.append(len(text.encode()))
            return {id_col: batch.column(0), "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_arrow(
        docs.select(id_col, "text"),
        make,
        f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
