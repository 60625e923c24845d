"""Near duplicates by BagMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles.  The weight axis of a shingle is cut into the
unit interval and dyadic intervals behind it, each with a Poisson process of rate one per unit;
a point lands in one of the signature's slots, and the earliest point below the text's weight in
each slot is its signature.  Two slots agree with the probability of the weighted Jaccard
similarity.  Points come in rounds, vectorised over many texts, and a process stops when its time
has passed the latest slot of its text.

Slots are banded.  Exact copies (equal word sequences) are one node from the start.  In a band's
bucket each node is checked against the smallest node; buckets that still hold several components
are then worked through in blocks inside a task, where pairs of different components whose
signatures are near are checked until they are joined, so a large bucket never becomes a list of
all its pairs.  Every link is verified on the exact multisets.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches
from .components import components, groups, heavy_keys, is_heavy, keyed_join
from .words import BASE, GOLDEN, TO_LOWER, U, mix, shingles

BANDS, ROWS = 28, 5
SLOTS = BANDS * ROWS
#: Texts whose shingles are sketched together.
TEXTS_AT_ONCE = 64
BLOCK = 512


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def multisets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, shingle and weight of every distinct shingle of each text, in order."""
    h, n = shingles(texts, width)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def bag_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """The BagMinHash signature of each text (times of the earliest points; inf without shingles)."""
    parts = [(owner, element, np.zeros(len(owner), np.int64), np.ones(len(owner), np.int64), weight)]
    low = 1
    while len(more := np.flatnonzero(weight > low)):
        # The interval [low, 2 low); texts of a weight inside it keep the points below their weight.
        k = np.full(len(more), low)
        parts.append((owner[more], element[more], k, k, weight[more]))
        low *= 2
    own, seed, start, rate, top = (np.concatenate(x) for x in zip(*parts))
    with np.errstate(over="ignore"):
        seed = mix(seed + start.astype(np.uint64) * GOLDEN)
    best = np.full(texts * slots, np.inf)
    time = np.zeros(len(own))
    step = 0
    while len(own):
        step += 1
        with np.errstate(over="ignore"):
            a = mix(seed + U(2 * step) * BASE)
            b = mix(a + GOLDEN)
        time = time - np.log(_uniform(a)) / rate
        slot = (b % U(slots)).astype(np.int64)
        place = start + _uniform(mix(b)) * rate
        lands = place <= top
        np.minimum.at(best, own[lands] * slots + slot[lands], time[lands])
        last = best.reshape(texts, slots).max(axis=1)
        live = time < last[own]
        own, seed, start, rate, top, time = own[live], seed[live], start[live], rate[live], top[live], time[live]
    return best.reshape(texts, slots)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted elements and weights."""
    _, i, k = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][k]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def node_of(text: str) -> bytes:
    """Equal for texts of equal word sequences."""
    return hashlib.blake2b(b" ".join((text or "").encode().translate(TO_LOWER).split()), digest_size=16).digest()


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """``node, empty, bands array<bigint>, slots binary`` for every row, in the order of the columns of ``docs``."""

    def make():
        def step(batch):
            texts = [v.as_py() or "" for v in batch.column(1)]
            nodes = [node_of(t) for t in texts]
            bands, slots, empty = [], [], []
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                part = texts[i : i + TEXTS_AT_ONCE]
                owner, element, weight = multisets(part, width)
                best = bag_signatures(owner, element, weight, len(part))
                bits = mix(best.view(np.uint64))
                with np.errstate(over="ignore"):
                    h = np.zeros((len(part), BANDS), np.uint64)
                    for r in range(ROWS):
                        h = mix(h * BASE + bits[:, r::ROWS][:, :BANDS])
                    h = mix(h + np.arange(BANDS, dtype=np.uint64) * GOLDEN)
                bands += list(h.view(np.int64))
                slots += [x.tobytes() for x in (bits >> U(48)).astype(np.uint16)]
                empty += np.isinf(best[:, 0]).tolist()
            return {"id": batch.column(0), "node": nodes, "empty": empty, "bands": bands, "slots": slots}

        return step

    kind = docs.dtypes[0][1]
    return map_arrow(docs, make, f"id {kind}, node binary, empty boolean, bands array<bigint>, slots binary")


#: Nodes that a task remembers having named; it bounds a worker's memory.
REMEMBERED = 1 << 17


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text``: one text for each wanted node.

    A task names a text once, so the copies of one text, however many, bring a row for each task."""

    def name():
        seen: set[bytes] = set()

        def step(batch):
            nodes, kept = [node_of(v.as_py()) for v in batch.column(0)], []
            for i, node in enumerate(nodes):
                if node not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    kept.append(i)
            return {"node": [nodes[i] for i in kept], "text": batch.column(0).take(pa.array(kept, pa.int32()))}

        return step

    named = map_arrow(docs.select(F.coalesce("text", F.lit("")).alias("text")), name, "node binary, text string")
    return named.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def verified(docs: DataFrame, pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by ``threshold`` or more."""
    full = cut(texts_of(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    left, right = (full.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = pairs.join(right, "b").join(left, "a")

    def check():
        @lru_cache(64)
        def bag(text):
            _, element, weight = multisets([text], width)
            return element, weight

        def step(batch):
            rows = [batch.column(i) for i in range(4)]
            keep = [
                overlap(bag(x.as_py()), bag(y.as_py())) >= threshold - 1e-12 for x, y in zip(rows[2], rows[3])
            ]
            mask = pa.array(keep)
            return {"a": rows[0].filter(mask), "b": rows[1].filter(mask)}

        return step

    return map_arrow(joined.select("a", "b", "text_a", "text_b"), check, "a binary, b binary")


def near_slots(g: pa.Table, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components, of different blocks where there are two, with near signatures."""
    sig = np.stack([np.frombuffer(x, np.uint16) for x in g.column("slots").to_pylist()])
    root = np.unique(np.array([r.hex() for r in g.column("root").to_pylist()]), return_inverse=True)[1]
    block = np.asarray(g.column("mine"))
    cross = block.min() != block.max()
    a, b, how = [], [], []
    for i in range(len(sig)):
        if cross and block[i] != block.min():
            continue
        share = (sig == sig[i]).mean(axis=1)
        fits = np.flatnonzero((share >= near) & (root != root[i]) & ((block != block[i]) if cross else (np.arange(len(sig)) > i)))
        a.append(np.full(len(fits), i, np.int32))
        b.append(fits.astype(np.int32))
        how.append(share[fits].astype(np.float32))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int32) for x in (a, b, how))


def residual_links(docs: DataFrame, members: DataFrame, sketched: DataFrame, roots: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links between different components that share a bucket: enough of them to join what belongs together.

    Buckets are compared block against block.  A first pass on signatures finds the nodes that have
    a near one of another component; only these bring their texts, and their pairs are verified
    from the nearest on, skipping those that earlier links have joined.
    """
    rooted = cut(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_buckets = (
        rooted.groupBy("bucket")
        .agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"))
        .where("r0 <> r1")
        .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    slots = sketched.select("node", "slots").dropDuplicates(["node"])
    rows = (
        keyed_join(rooted, open_buckets, "bucket")
        .join(slots, "node")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.concat_ws("/", F.col("bucket").cast("string"), F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
            "node", "root", "slots", "mine",
        )
    )
    # Five standard deviations of the estimate below the threshold.
    near = threshold - 5 * (threshold * (1 - threshold) / SLOTS) ** 0.5
    dealt = lambda df: df.repartition("key").sortWithinPartitions("key")

    def pick(batches):
        for g in groups(batches, "key"):
            a, b, _ = near_slots(g, near)
            if len(a):
                yield from g.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()

    picked = cut(dealt(rows).mapInArrow(pick, rows.schema))
    full = cut(texts_of(docs, picked.select("node").distinct()))

    def link(batches):
        for g in groups(batches, "key"):
            a, b, how = near_slots(g, near)
            nodes, texts = g.column("node").to_pylist(), g.column("text").to_pylist()
            above = {r: r for r in g.column("root").to_pylist()}
            root = g.column("root").to_pylist()

            def find(x):
                while above[x] != x:
                    above[x] = above[above[x]]
                    x = above[x]
                return x

            bags: dict[int, tuple] = {}

            def bag(i):
                if i not in bags:
                    bags[i] = multisets([texts[i]], width)[1:]
                return bags[i]

            out = []
            nearest = np.argsort(-how, kind="stable").astype(np.int32)
            for p in nearest:
                i, k = int(a[p]), int(b[p])
                x, y = find(root[i]), find(root[k])
                if x != y and overlap(bag(i), bag(k)) >= threshold - 1e-12:
                    above[x] = y
                    out.append((nodes[i], nodes[k]))
            if out:
                x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

    return dealt(picked.join(full, "node")).mapInArrow(link, "a binary, b binary")


def classes(docs: DataFrame, threshold: float, width: int, id_col: str) -> DataFrame:
    """``id, node, empty, class_id, kept`` for every row."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), "text")
    sketched = cut(sketch(named, width))
    filled = sketched.where("not empty")
    distinct = filled.groupBy("node").agg(F.first("bands").alias("bands"))
    banded = distinct.select("node", F.explode("bands").alias("bucket"))
    # A bucket of one node is done; of the others the smallest node is the pivot.
    heavy = is_heavy("bucket", heavy_keys(banded, "bucket"))
    in_bucket = Window.partitionBy("bucket")
    light = banded.where(~heavy).withColumns({"a": F.min("node").over(in_bucket), "z": F.max("node").over(in_bucket)})
    # Buckets of many nodes are few: their ends are summed up in parts and sent to the nodes.
    ends = banded.where(heavy).groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    members = cut(light.unionByName(banded.where(heavy).join(F.broadcast(ends), "bucket")).where("a <> z").drop("z"))
    pairs = cut(members.where("a <> node").select("a", F.col("node").alias("b")).distinct())
    links = cut(verified(named, pairs, threshold, width))
    roots = cut(components(links))
    more = cut(residual_links(named, members, filled, roots, threshold, width))
    if not more.isEmpty():
        roots = cut(components(links.union(more)))
    # Rows without shingles get a class each; a copy's class is found through its node.
    rows = sketched.select("id", "node", "empty").withColumn("row", F.monotonically_increasing_id())
    filled_rows = rows.where("not empty")
    facts = filled_rows.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"))
    alone = rows.where("empty").withColumn("class", F.col("row").cast("string").cast("binary"))
    placed = keyed_join(filled_rows, facts, "node").unionByName(alone)
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    placed = cut(placed)
    heads = placed.groupBy("class").agg(F.min(first).alias("head"))
    return keyed_join(placed, heads, "class").select(
        "id", "node", "empty", F.col("head.id").alias("class_id"), (F.col("row") == F.col("head.row")).alias("kept")
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Rows ``id_col, class_id, kept`` for every row of ``docs``.

    ``class_id`` is the smallest id of the row's connected component of links of ``threshold`` or
    more; ``kept`` marks one row of each class, the one of the smallest id (of equal ids, or
    without any id, one of them).  Rows of equal word sequences are copies of each other; texts of
    under ``width`` words compare as one shingle; null and empty texts and texts of white space
    only have no shingles and each stands alone.  Null ids come after all others; an empty table
    gives an empty table; other columns are ignored.
    """
    return classes(docs, threshold, width, id_col).select(F.col("id").alias(id_col), "class_id", "kept")


def deduplicate(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id") -> DataFrame:
    """One row of each class of :func:`near_duplicates`, with all columns of ``docs``."""
    kept = classes(docs, threshold, width, id_col).where("kept").select("id", "node", "empty")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("d"), docs[id_col].alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def name(batches):
        for batch in batches:
            node = pa.array([node_of(v.as_py()) for v in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node], ["d", "id", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = packed.mapInArrow(name, f"d {packed.schema['d'].dataType.simpleString()}, id {kind}, node binary")
    # Rows of one id and one text are told apart by nothing, so the first of them stays.  Copies of a
    # text under other ids meet in no task, since the id is part of the key.
    same = Window.partitionBy("node", "id").orderBy("id")
    heads = kept.where("not empty").select("node", "id").distinct()
    found = named.join(heads, (named["node"] == heads["node"]) & named["id"].eqNullSafe(heads["id"]), "left_semi")
    one = found.withColumn("n", F.row_number().over(same)).where("n = 1").select("d")
    without = docs.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]", " ")) == "")
    return one.select(*(F.col("d").getField(c).alias(c) for c in docs.columns)).union(without)
