"""Near duplicates among vectors by p-stable hashing, with exact cosine checks.

Normalised vectors are projected on random Gaussian directions; a projection is shifted, divided
by the bucket width and rounded down, and some such numbers together name a bucket of one table.
Several tables are drawn so that a pair at the threshold misses all of them with a probability of
``MISS``.  The number of projections grows with the logarithm of the number of distinct vectors,
which keeps the mean bucket at a fixed size.

Equal vectors are one node.  Buckets are found from codes alone; only nodes with a neighbour in some
bucket bring their vectors.  In a bucket all pairs are checked by one matrix product, and those close
to the threshold once more in a fixed order of summation; large buckets are dealt out as pairs of
blocks.  A pair that meets in several tables counts in the first one only, so links are counted
without listing them, and a bucket sends on just one link for each node towards its group, which is
all that components need.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches
from .components import components, keyed_join

WIDTH = 2.0
MISS = 1e-4
MEAN_BUCKET = 512
BLOCK = 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """How likely one p-stable hash is equal for two points at ``distance``."""
    if distance == 0:
        return 1.0
    t = width / distance
    below = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(vectors: int, threshold: float) -> tuple[int, int]:
    """Projections for each table, and tables."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(vectors, 1) / MEAN_BUCKET) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


#: What names a bucket's pair of blocks.
KEY = ("table", "code", "low", "high")


def _buckets(batches):
    """``key, mine, node, (vector bytes, offsets), copies, codes`` of each pair of blocks, from batches of rows
    sorted by ``KEY`` with columns mine, node, vector, copies, codes behind it."""
    held: list[pa.RecordBatch] = []
    held_key = None

    def whole():
        g = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: g.column(name).chunk(0)
        v = column("vector")
        offsets = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
        codes = column("codes").flatten()
        return (
            held_key, np.asarray(column("mine")), column("node"), (v.buffers()[2], offsets), np.asarray(column("copies")),
            np.asarray(codes).reshape(len(v), -1),
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)) for i in range(len(KEY))], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(keys[a].tolist())
            if held and own != held_key:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
            held_key = own
    if held:
        yield whole()


#: Products this close to the threshold are summed up once more.
CLOSE = 1e-9
PAIRS_AT_ONCE = 1 << 16


def _links(x: np.ndarray, mine: np.ndarray, copies: np.ndarray, codes: np.ndarray, cross: bool, threshold: float):
    """Rows ``a, b, links``: each row with a link, one row of its group, and the copies it is linked to and
    that no table before has counted.  With ``cross`` only pairs of different blocks are looked at."""
    if cross:
        rows, columns = np.flatnonzero(mine == mine.min()), np.flatnonzero(mine != mine.min())
    else:
        rows = columns = np.arange(len(x))
    product = x[rows] @ x[columns].T
    near = product >= threshold - CLOSE
    if not cross:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    unsure = np.flatnonzero(product[a, b] < threshold + CLOSE)
    a, b = rows[a], columns[b]
    good = np.ones(len(a), bool)
    for i in range(0, len(unsure), PAIRS_AT_ONCE):
        at = unsure[i : i + PAIRS_AT_ONCE]
        good[at] = np.einsum("ij,ij->i", x[a[at]], x[b[at]]) >= threshold
    a, b = a[good], b[good]
    if not len(a):
        return None
    links = np.zeros(len(x), np.int64)
    for i in range(0, len(a), PAIRS_AT_ONCE):
        p, q = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
        fresh = ~(codes[p] == codes[q]).any(axis=1)
        np.add.at(links, p[fresh], copies[q[fresh]])
        np.add.at(links, q[fresh], copies[p[fresh]])
    root = np.arange(len(x))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    told = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
    return told, root[told], links[told]


def unit_rows(values: list) -> tuple[np.ndarray, list[int]]:
    """Unit vectors of the usable entries of one length, in double precision."""
    x = np.array(values, np.float64)
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(v) -> bool:
    return v is not None and len(v) > 0 and not any(c is None or not math.isfinite(c) for c in v) and any(c != 0 for c in v)


def _node(v: list[float]) -> bytes:
    # Adding zero turns a negative zero into zero.
    return hashlib.blake2b((np.array(v, np.float64) + 0.0).tobytes(), digest_size=16).digest()


def link_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17) -> DataFrame:
    """Rows ``id_col, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and
    are a component each; so are vectors of different lengths to each other.  Rows of equal
    vectors, repeated rows included, link with one another.  Null ids come after all others; an
    empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    kind = vectors.schema[id_col].dataType.simpleString()
    # Vectors travel as they are stored; they are worked on in double precision.
    held = np.dtype(np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64)

    def name():
        def step(batch):
            values = batch.column(1).to_pylist()
            good = [usable(v) for v in values]
            return {
                "id": batch.column(0),
                "node": [_node(v) if ok else None for v, ok in zip(values, good)],
                "vector": [np.array(v, held).tobytes() if ok else None for v, ok in zip(values, good)],
            }

        return step

    rows = cut(
        map_arrow(vectors.select(id_col, vector_col), name, f"id {kind}, node binary, vector binary").withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    distinct = cut(rows.where("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies")))
    k, tables = plan(distinct.count(), threshold)

    def coded():
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def step(batch):
            raw = batch.column(1).to_pylist()
            codes: list = [None] * len(raw)
            lengths = np.array([len(x) // held.itemsize for x in raw])
            for d in np.unique(lengths):
                if d not in made:
                    rng = np.random.default_rng([seed, int(d)])
                    made[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, WIDTH, tables * k)
                at = np.flatnonzero(lengths == d)
                direction, shift = made[d]
                x = unit_rows([np.frombuffer(raw[i], held) for i in at])
                cell = np.floor((x @ direction + shift) / WIDTH).astype(np.int64).reshape(len(at), tables, k)
                mixer = np.random.default_rng([seed, 1]).integers(1, 1 << 62, k) | 1
                code = ((cell * mixer).sum(axis=2) ^ (int(d) * 0x9E3779B1)) & 0x7FFFFFFFFFFFFFFF
                for i, c in zip(at, (code % 0x7FFFFFFF).astype(np.int32)):
                    codes[i] = c
            return {"node": batch.column(0), "vector": raw, "copies": batch.column(2), "codes": codes}

        return step

    sketched = cut(map_arrow(distinct, coded, "node binary, vector binary, copies bigint, codes array<int>"))
    coded_rows = sketched.select("node", F.posexplode("codes").alias("table", "code")).withColumn("bucket", F.struct("table", "code"))
    size = coded_rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = size.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        keyed_join(coded_rows, blocks, "bucket")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "table", "code", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
        .join(sketched.select("node", "vector", "copies", "codes"), "node")
        # Tables before this one: a pair that met there has been counted.
        .select(*KEY, "mine", "node", "vector", "copies", F.slice("codes", F.lit(1), F.col("table")).alias("codes"))
    )

    def run(batches):
        for own, mine, node, vectors, copies, codes in _buckets(batches):
            lengths = np.diff(vectors[1])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                if len(at) > 1:
                    flat = np.frombuffer(vectors[0], np.uint8)
                    x = unit_rows(np.stack([flat[vectors[1][i] : vectors[1][i + 1]] for i in at]).view(held))
                    told = _links(x, mine[at], copies[at], codes[at], own[2] != own[3], threshold)
                    if told is not None:
                        a, b, links = told
                        yield pa.RecordBatch.from_arrays([node.take(pa.array(at[a])), node.take(pa.array(at[b])), pa.array(links)], ["a", "b", "links"])

    found = cut(dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, "a binary, b binary, links bigint"))
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    facts = distinct.select("node", "copies").join(links, "node", "left").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    linked = keyed_join(rows.where("node is not null").select("id", "node", "row"), facts, "node").select("id", "row", "class", "n_links")
    alone = rows.where("node is null").select("id", "row", F.col("row").cast("string").cast("binary").alias("class"), F.lit(0).cast("bigint").alias("n_links"))
    placed = cut(linked.unionByName(alone))
    heads = placed.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("head"))
    return keyed_join(placed, heads, "class").select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("bigint").alias("n_links"),
        F.col("head.id").alias("component_id"),
        F.coalesce(F.col("id") == F.col("head.id"), F.lit(False)).alias("kept"),
    )
