"""Language-model scores from a log-frequency Bloom filter.

Training counts words and word pairs.  A count c is quantised to level 1 + floor(log2 c), and the
filter holds (n-gram, 1) ... (n-gram, level); a worker finds a count again by probing levels until
one is absent.  Every pair is held; ``pair_min`` may leave out pairs of smaller counts.

Counts are gathered by shard of the n-gram's hash: every task sends sorted hashes and counts for
each shard, and a shard's merge adds them up and sets the bits of its own part of the filter.
The parts are broadcast while exact word counts and filter stay under ``broadcast_bytes``; beyond
that, n-grams are sent to the shards of the filter and probed there.  Scores are the same both ways.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches
from .words import BASE, END, GOLDEN, START, U, hash_texts, mix

BITS_PER_ENTRY, PROBES = 10, 7
PAIR_WEIGHT = 0.4
#: N-grams held in a task before they are summed and sent on.
HELD = 1 << 21
#: Bytes of text for which the filter has one shard, so a shard's n-grams are bounded whatever the corpus.
SHARD_BYTES = 8 << 20
#: Bytes of text whose n-grams are asked of the shards together.
CHUNK_BYTES = 8 << 20


def held_out(doc_id) -> bool:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 modulo 7."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The mid-point of a level's counts; level 0 is 0."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0**levels - 1) / 2, 0.0)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (each text's words, then its end), the token before each, their pair, and counts per text."""
    words, n = hash_texts(texts)
    token = np.insert(words, np.cumsum(n), END)
    n = n + 1
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(n) - n] = START
    with np.errstate(over="ignore"):
        pair = mix(before * BASE + token + GOLDEN)
    return token, before, pair, n


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands there."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def bits_at(keys: np.ndarray, levels: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The bit places of (key, level) in a filter of ``size`` bits, one row for each probe."""
    with np.errstate(over="ignore"):
        a = mix(keys ^ (levels.astype(np.uint64) * BASE))
        b = mix(a + GOLDEN) | U(1)
        return np.stack([(a + U(k) * b) % np.asarray(size, np.uint64) for k in range(PROBES)])


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of one shard's filter."""
    top = level(counts) if len(counts) else np.empty(0, np.int64)
    bits = max(64, -(-int(top.sum()) * BITS_PER_ENTRY // 64) * 64)
    data = np.zeros(bits, bool)
    for k in range(1, int(top.max(initial=0)) + 1):
        held = keys[top >= k]
        data[bits_at(held, np.full(len(held), k), bits).ravel().astype(np.int64)] = True
    return np.packbits(data, bitorder="little")


def packed(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one needs more."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64).tobytes()


def unpacked(counts: bytes, keys: bytes) -> np.ndarray:
    return np.frombuffer(counts, np.uint32 if len(counts) * 2 == len(keys) else np.int64)


def probed(bits_held: np.ndarray, keys: np.ndarray, size: np.ndarray | int, start: np.ndarray | int = 0) -> np.ndarray:
    """The level up to which each key is in its filter of ``size`` bits from bit ``start`` on."""
    size, start = (np.broadcast_to(np.asarray(x, np.uint64), len(keys)) for x in (size, start))
    found = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    for k in range(1, 64):
        places = bits_at(keys[live], np.full(len(live), k), size[live]) + start[live]
        there = np.ones(len(live), bool)
        for row in places:
            there &= (bits_held[(row >> U(3)).astype(np.int64)] >> (row & U(7)).astype(np.uint8)) & 1 == 1
        live = live[there]
        if not len(live):
            break
        found[live] = k
    return found


def found_in(own: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The counts of ``keys`` among the ordered keys ``own``."""
    if not len(own):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, counts[at], 0).astype(np.int64)


class Model:
    """What workers get: exact word counts, the filter's parts side by side, and the totals.

    The arrays are laid out at once and filled shard by shard as ``rows`` arrive, so the driver
    never holds the parts and the whole together.  A shard's words are in order."""

    def __init__(self, shards: int, rows, distinct: int, filter_bytes: int, train_texts: int):
        self.shards, self.texts, self.distinct = shards, train_texts, distinct
        self.keys, self.counts = np.empty(distinct, np.uint64), np.empty(distinct, np.uint32)
        # A shard that never arrives has one empty word of filter.
        self.filter = np.zeros(filter_bytes + 8, np.uint8)
        self.first, self.words = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        self.start, self.size = np.full(shards, filter_bytes * 8, np.uint64), np.full(shards, 64, np.uint64)
        at = bits = 0
        for r in rows:
            s, bloom = r["shard"], np.frombuffer(r["filter"], np.uint8)
            own, counts = np.frombuffer(r["words"], np.uint64), unpacked(r["counts"], r["words"])
            if counts.dtype.itemsize > self.counts.dtype.itemsize:
                self.counts = self.counts.astype(np.int64)
            self.keys[at : at + len(own)], self.counts[at : at + len(own)] = own, counts
            self.first[s], self.words[s] = at, len(own)
            self.filter[bits : bits + len(bloom)] = bloom
            self.start[s], self.size[s] = bits * 8, len(bloom) * 8
            at, bits = at + len(own), bits + len(bloom)
        self.total = int(self.counts.sum(dtype=np.int64))

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of words in training; ``keys`` are in order."""
        found = np.zeros(len(keys), np.int64)
        shard = (keys % U(self.shards)).astype(np.uint16 if self.shards < 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds) * self.words):
            asked = order[bounds[s] : bounds[s + 1]]
            own = self.keys[self.first[s] : self.first[s] + self.words[s]]
            found[asked] = found_in(own, self.counts[self.first[s] : self.first[s] + self.words[s]], keys[asked])
        return found

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Levels found by membership probes, level after level."""
        shard = (keys % U(self.shards)).astype(np.int64)
        return probed(self.filter, keys, self.size[shard], self.start[shard])


def scores(token, before, pair, n, exact, word_level, before_level, pair_level, total, distinct, texts):
    """Known tokens, base score and model score of each text."""
    owner = np.repeat(np.arange(len(n)), n)
    base = np.log10((exact + 1) / (total + distinct + 1))
    alone = (np.minimum(count_of(word_level), total) + 1) / (total + distinct + 1)
    context = np.where(before == START, float(texts), count_of(before_level))
    together = count_of(pair_level)
    share = np.divide(together, np.maximum(context, together), out=np.zeros(len(together)), where=together > 0)
    p = np.where(context > 0, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * alone, alone)
    add = lambda x: np.bincount(owner, weights=x, minlength=len(n))
    return add(exact > 0).astype(np.int64), add(base), add(np.log10(p))


def shard_counts(docs: DataFrame, shards: int, id_col: str) -> DataFrame:
    """``shard, kind (0 words, 1 pairs, 2 training texts), keys, counts``: what each task has seen."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        size = texts = 0

        def send():
            nonlocal size, texts
            rows = []
            for kind, arrays in held.items():
                keys, counts = summed(np.concatenate(arrays))
                own = (keys % U(shards)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                keys, counts, own = keys[order], counts[order], own[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
                for a, b in zip(first, [*first[1:], len(own)]):
                    few = counts[a:b] < 256
                    # Nearly all counts of a task take one byte, which is a quarter less to send.
                    for part, kept in ((few, np.uint8), (~few, np.uint32)):
                        if part.any():
                            rows.append((int(own[a]), kind, keys[a:b][part].tobytes(), counts[a:b][part].astype(kept).tobytes()))
            rows.append((0, 2, b"", np.array([texts], np.uint32).tobytes()))
            held.clear()
            size = texts = 0
            shard, kinds, keys, counts = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                ["shard", "kind", "keys", "counts"],
            )

        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1)
            part = [values[i].as_py() or "" for i, d in enumerate(ids) if not held_out(d)]
            if part:
                token, _, pair, _ = grams(part)
                held[0].append(token)
                held[1].append(pair)
                size += len(token)
                texts += len(part)
            if size >= HELD:
                yield send()
        if size:
            yield send()

    return docs.select(id_col, "text").mapInArrow(run, "shard int, kind int, keys binary, counts binary")


def train(docs: DataFrame, shards: int, pair_min: int, id_col: str = "doc_id") -> DataFrame:
    """One row for each shard: exact words and counts, the filter, totals."""

    class Tally:
        """Keys and counts, summed whenever enough of them have come."""

        def __init__(self):
            self.keys, self.counts, self.size = [], [], 0

        def add(self, keys: bytes, counts: bytes) -> None:
            self.keys.append(np.frombuffer(keys, np.uint64))
            self.counts.append(np.frombuffer(counts, np.uint8 if len(counts) * 8 == len(keys) else np.uint32).astype(np.int64))
            self.size += len(self.keys[-1])
            if self.size > HELD and len(self.keys) > 1:
                self.sums()
                self.size = 0

        def sums(self) -> tuple[np.ndarray, np.ndarray]:
            if self.keys:
                keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
                self.keys, self.counts = [keys], [counts]
            return (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, texts = (Tally(), Tally()), 0
        for batch in batches:
            for kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "counts"))):
                if kind == 2:
                    texts += int(np.frombuffer(counts, np.uint32)[0])
                else:
                    tallies[kind].add(keys, counts)
        (words, counts), (pairs, pair_counts) = (t.sums() for t in tallies)
        pairs, pair_counts = pairs[pair_counts >= pair_min], pair_counts[pair_counts >= pair_min]
        bits = build_filter(np.concatenate([words, pairs]), np.concatenate([counts, pair_counts]))
        row = (key[0].as_py(), words.tobytes(), packed(counts), bits.tobytes(), int(counts.sum()), len(words), texts)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "words", "counts", "filter", "total", "distinct", "texts"])

    schema = "shard int, words binary, counts binary, filter binary, total bigint, distinct bigint, texts bigint"
    return shard_counts(docs, shards, id_col).groupBy("shard").applyInArrow(merge, schema)


COLUMNS = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def lm_scores(
    docs: DataFrame,
    pair_min: int = 1,
    broadcast_bytes: int = 160 << 20,
    id_col: str = "doc_id",
) -> DataFrame:
    """Rows ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null and empty texts have one token, their end; a null id counts as training; repeated rows
    train and score each for itself; an empty table gives an empty table; without any training
    text every count is 0; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    parts = cut(train(docs, shards, pair_min, id_col))
    facts = parts.agg(
        F.sum("total").alias("total"),
        F.sum("distinct").alias("distinct"),
        F.sum("texts").alias("texts"),
        F.sum(F.length("filter")).alias("filter_bytes"),
        F.sum(F.length("words") + F.length("counts") + F.length("filter")).alias("bytes"),
    ).first()
    total, distinct, texts = facts["total"] or 0, facts["distinct"] or 0, facts["texts"] or 0
    if (facts["bytes"] or 0) > broadcast_bytes:
        return _routed(docs, parts, shards, total, distinct, texts, id_col)
    rows = parts.select("shard", "words", "counts", "filter").toLocalIterator()
    sent = spark.sparkContext.broadcast(Model(shards, rows, distinct, facts["filter_bytes"] or 0, texts))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model = sent.value

        def step(batch):
            ids = batch.column(0).to_pylist()
            token, before, pair, n = grams([v.as_py() or "" for v in batch.column(1)])
            keys, back = np.unique(np.concatenate([token, before]), return_inverse=True)
            exact, probed = model.exact(keys), model.probe(keys)
            pairs, pair_back = np.unique(pair, return_inverse=True)
            at, at_before = back[: len(token)], back[len(token) :]
            known, base, score = scores(
                token, before, pair, n, exact[at], probed[at], probed[at_before], model.probe(pairs)[pair_back],
                model.total, model.distinct, model.texts,
            )
            return {
                id_col: batch.column(0),
                "held_out": [held_out(d) for d in ids],
                "n_tokens": n,
                "n_known": known,
                "train_tokens": np.full(len(n), model.total),
                "base_score": base,
                "score": score,
            }

        return step

    return map_arrow(docs.select(id_col, "text"), make, f"`{id_col}` {kind}, {COLUMNS}")


def _chunks(docs: DataFrame) -> DataFrame:
    """``chunk, id, text`` of ``docs`` (row, id, text): rows in a row share a chunk, named by its first row."""

    def run(batches):
        chunk, size = None, 0
        for batch in batches:
            names = []
            for row, width in zip(batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
                if chunk is None or size >= CHUNK_BYTES:
                    chunk, size = row, 0
                names.append(chunk)
                size += width + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(1), batch.column(2)], ["chunk", "id", "text"])

    return docs.mapInArrow(run, f"chunk bigint, id {docs.schema['id'].dataType.simpleString()}, text string")


def _asked(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk's distinct keys are asked, shard after shard, and each shard's bounds."""
    own = (keys % U(shards)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(shards + 1))


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary for each run of ``values`` between two bounds."""
    places = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values))])


def _gathered(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _routed(docs: DataFrame, parts: DataFrame, shards: int, total: int, distinct: int, texts: int, id_col: str) -> DataFrame:
    """The way beyond the broadcast bound: a chunk's distinct n-grams go to the shards that hold them,
    are probed and counted there, and the answers come back to the chunk's texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.monotonically_increasing_id().alias("row")
    chunks = cut(_chunks(docs.select(row, F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))))

    def ask(batches):
        def send(chunk, held):
            token, before, pair, _ = grams(held)
            columns = []
            for keys in (np.unique(np.concatenate([token, before])), np.unique(pair)):
                order, bounds = _asked(keys, shards)
                columns.append(_binaries(keys[order], bounds))
            batch = pa.RecordBatch.from_arrays([pa.array(np.full(shards, chunk)), pa.array(np.arange(shards, dtype=np.int32)), *columns], ["chunk", "shard", "words", "pairs"])
            return batch.filter(pc.greater(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))), 0))

        chunk, held = None, []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != chunk:
                    if held:
                        yield send(chunk, held)
                    chunk, held = name, []
                held.append(text.as_py() or "")
        if held:
            yield send(chunk, held)

    def answer(batches):
        """Questions stream past their shard's row, which comes before them."""
        held, own, counts, bits = None, np.empty(0, np.uint64), np.empty(0, np.uint32), None
        for batch in batches:
            out = []
            for shard, chunk, words, pairs, known, bloom in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != held:
                    held, own, counts, bits = shard, np.empty(0, np.uint64), np.empty(0, np.uint32), None
                if chunk is None:
                    own, counts, bits = np.frombuffer(words, np.uint64), unpacked(known, words), np.frombuffer(bloom, np.uint8)
                    continue
                words, pairs = np.frombuffer(words, np.uint64), np.frombuffer(pairs, np.uint64)
                level_of = lambda x: (np.zeros(len(x), np.uint8) if bits is None else probed(bits, x, len(bits) * 8).astype(np.uint8))
                out.append((chunk, shard, found_in(own, counts, words).tobytes(), level_of(words).tobytes(), level_of(pairs).tobytes()))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["chunk", "shard", "exact", "word_level", "pair_level"])

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        token, before, pair, n = grams([v.as_py() or "" for v in own["text"]])
        keys, back = np.unique(np.concatenate([token, before]), return_inverse=True)
        pairs, pair_back = np.unique(pair, return_inverse=True)
        answers = answers.sort_by("shard")

        def put(keys, column, dtype):
            out = np.empty(len(keys), np.int64)
            out[_asked(keys, shards)[0]] = _gathered(answers[column], dtype)
            return out

        exact, level_of = put(keys, "exact", np.int64), put(keys, "word_level", np.uint8)
        at, at_before = back[: len(token)], back[len(token) :]
        known, base, model = scores(
            token, before, pair, n, exact[at], level_of[at], level_of[at_before], put(pairs, "pair_level", np.uint8)[pair_back], total, distinct, texts
        )
        columns = [own["id"], [held_out(d) for d in own["id"].to_pylist()], n, known, np.full(len(n), total), base, model]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], [id_col, *(c.split()[0] for c in COLUMNS.split(", "))])

    asked = chunks.select("chunk", "text").mapInArrow(ask, "chunk bigint, shard int, words binary, pairs binary")
    nothing = F.lit(None).cast("binary")
    rows = parts.select("shard", F.lit(None).cast("bigint").alias("chunk"), "words", nothing.alias("pairs"), "counts", "filter").unionByName(
        asked.select("shard", "chunk", "words", "pairs", nothing.alias("counts"), nothing.alias("filter"))
    )
    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("chunk"))
    answers = dealt.mapInArrow(answer, "chunk bigint, shard int, exact binary, word_level binary, pair_level binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"`{id_col}` {kind}, {COLUMNS}")
