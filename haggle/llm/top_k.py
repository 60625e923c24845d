"""Exact top-k by inner product with a ball tree in each shard.

Vectors are dealt to the nearest of a bounded number of pivots, and each pivot's cell is split into
shards of a bounded size.  A shard's rows become a ball tree: a node keeps the centre and radius of its
vectors, so that no inner product below it exceeds ``q . centre + |q| radius``.  A block of queries goes
down the tree together, the child of the higher bound first, and a query leaves a node whose bound is
under its kth score.

Queries go to shards in three rounds: to their own shard, to the few of the highest bound, and to all
whose bound reaches the kth score.  Between rounds the kth of all scores found so far is shared, and a
query only ever goes to shards whose cell can reach it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches
from .components import groups

LEAF = 64
SHARD_ROWS = 8192
QUERIES_AT_ONCE = 256
#: Pivots at most: their vectors, radii and counts are what every task gets.
PIVOTS = 512
#: Shards of a query's second round.
NEAR = 4
#: Up to this size of components and this length, doubles hold all sums exactly.
EXACT, EXACT_LENGTH = 1 << 20, 1 << 13
#: Rows of a block where scores take whole numbers of any size.
WIDE_BLOCK = 1024
LONG = (1 << 63) - 1


class BallTree:
    """Integer vectors ``x`` with their ids; children of node i are listed after it."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.nodes: list[tuple] = []
        self._build(np.arange(len(x)))

    def _build(self, own: np.ndarray) -> int:
        stack = [(own, -1, 0)]
        while stack:
            own, parent, side = stack.pop()
            x = self.x[own]
            centre = x.mean(axis=0)
            away = np.sqrt(((x - centre) ** 2).sum(axis=1))
            at = len(self.nodes)
            self.nodes.append([centre, away.max(), own, None, None])
            if parent >= 0:
                self.nodes[parent][3 + side] = at
            if len(own) > LEAF and away.max() > 0:
                # Split along the line between two far-apart vectors, half and half.
                a = x[away.argmax()]
                b = x[((x - a) ** 2).sum(axis=1).argmax()]
                order = np.argsort(x @ (b - a), kind="stable")
                half = len(own) // 2
                stack += [(own[order[:half]], at, 0), (own[order[half:]], at, 1)]
                self.nodes[at][2] = None
        return 0

    def search(self, q: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[list, list]:
        """Scores and ids of each query's best k of score ``floor`` or more, other ids than its own."""
        n = len(q)
        size = np.sqrt((q * q).sum(axis=1))
        score = np.full((n, k), -np.inf)
        found = np.zeros((n, k), self.ids.dtype)
        kth = floor.copy()

        def bound(node, who):
            return bounds(q[who], size[who], node[0][:, None], node[1])[:, 0]

        stack = [(0, np.arange(n))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            who = who[bound(node, who) >= kth[who]]
            if not len(who):
                continue
            if node[2] is None:
                children = sorted((node[3], node[4]), key=lambda c: bound(self.nodes[c], who).sum())
                stack += [(c, who) for c in children]
                continue
            s = q[who] @ self.x[node[2]].T
            other = self.ids[node[2]]
            s = np.where((other[None, :] == ids[who][:, None]) | (s < kth[who][:, None]), -np.inf, s)
            hit = np.isfinite(s).any(axis=1)
            who, s = who[hit], s[hit]
            if not len(who):
                continue
            both = np.concatenate([score[who], s], axis=1)
            names = np.concatenate([found[who], np.broadcast_to(other, s.shape)], axis=1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            score[who], found[who] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            kth[who] = np.maximum(kth[who], score[who][:, -1])
        return score, found


def bounds(q: np.ndarray, size: np.ndarray, centres: np.ndarray, radius) -> np.ndarray:
    """No inner product of a query with a vector inside a ball is higher; centres are columns."""
    away = np.sqrt((centres * centres).sum(axis=0)) + radius
    # Rounding follows the sizes of the vectors, not that of their product.
    return q @ centres + size[:, None] * (radius + 1e-12 * away) + 1e-6


def integer_vector(v, scale: float) -> list[int] | None:
    """floor(scale * x) of every component; None for vectors that take no part."""
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    # A product beyond a double's range is taken as a whole number.
    return [math.floor(scale * float(c)) if math.isfinite(scale * float(c)) else math.floor(scale) * int(c) for c in v]


def _matrix(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    return x


def _padded(rows: list, width: int) -> np.ndarray:
    """Whole numbers of any size."""
    x = np.zeros((len(rows), width), object)
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    return x


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: each query's k highest scores, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of another id.
    Vectors that are null or hold null or non-finite components take no part, nor do rows of a
    null id; of vectors of different lengths the shorter one counts as filled up with zeros.
    Repeated rows are queries and candidates each for itself, and equal queries show the same
    list under one id once.  Vectors of components beyond 2**20 after scaling, or longer than
    8,192, are scored apart in whole numbers of any size; a score beyond a long's range is given as
    the largest or smallest long, and such scores tie.  Without queries or candidates the result is
    empty, and so it is for an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    chosen = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    number = chosen.count()
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    picked = chosen.where(F.col("v").isNotNull() & finite).orderBy(F.xxhash64("id", "v")).limit(min(PIVOTS, max(1, -(-number // SHARD_ROWS)))).collect()
    pivots = [p for p in (integer_vector(r["v"], scale) for r in picked) if len(p) <= EXACT_LENGTH and all(abs(c) <= EXACT for c in p)] or [[]]

    def place():
        def step(batch):
            rows = [integer_vector(v, scale) for v in batch.column(1).to_pylist()]
            plain = [v is not None and len(v) <= EXACT_LENGTH and all(abs(c) <= EXACT for c in v) for v in rows]
            at = [i for i, ok in enumerate(plain) if ok]
            width = max([len(p) for p in pivots] + [len(rows[i]) for i in at])
            x, p = _matrix([rows[i] for i in at], width), _matrix(pivots, width)
            cell, away = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            if at:
                # Any cell is right, as its radius is measured; the nearest makes it small.
                far = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
                cell[at] = far.argmin(axis=1)
                away[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(axis=1))
            return {
                "id": batch.column(0), "x": [v if ok else None for v, ok in zip(rows, plain)], "cell": cell, "away": away,
                "big": [None if ok or v is None else [str(c) for c in v] for v, ok in zip(rows, plain)],
            }

        return step

    rows = map_arrow(chosen, place, "id bigint, x array<int>, cell int, away double, big array<string>")
    rows = cut(rows.where("x is not null or big is not null"))
    plain = rows.where("x is not null")
    facts = {r["cell"]: r for r in plain.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max(F.size("x")).alias("d")).collect()}
    splits = [-(-facts[c]["n"] // SHARD_ROWS) if c in facts else 0 for c in range(len(pivots))]
    first = np.concatenate([[0], np.cumsum(splits)]).astype(int)
    shards, width = int(first[-1]), max([r["d"] for r in facts.values()] + [len(p) for p in pivots])
    radius = np.array([facts[c]["away"] if c in facts else 0.0 for c in range(len(pivots))])
    listed = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("cell") + 1)
    shard = listed(first[:-1]) + F.pmod(F.xxhash64("id", "x"), listed([max(1, n) for n in splits])).cast("int")
    plain = plain.select(shard.cast("int").alias("shard"), "id", "x")
    floor = F.lit(None).cast("double").alias("floor")
    candidates = plain.select("shard", F.lit(0).alias("asks"), "id", "x", floor)
    queries = plain.where(F.col("id") % every == 0).dropDuplicates(["id", "x"])

    def route(asked: DataFrame, near: bool) -> DataFrame:
        """Rows ``shard, id, x, floor``: of all but a query's own shard, the few of the highest bound, or the others, if their bound reaches the floor."""

        def run(batches):
            centres, owner = _matrix(pivots, width).T, np.repeat(np.arange(len(pivots)), splits)
            for batch in batches:
                home = np.asarray(batch.column(0))
                q = _matrix(batch.column(2).to_pylist(), width)
                high = bounds(q, np.sqrt((q * q).sum(axis=1)), centres, radius)[:, owner]
                low = np.array([-np.inf if f is None else f for f in batch.column(3).to_pylist()])
                ranked = high.copy()
                ranked[np.arange(len(home)), home] = -np.inf
                few = np.argsort(-ranked, axis=1, kind="stable")[:, :NEAR]
                wanted = np.zeros(high.shape, bool) if near else high >= low[:, None]
                np.put_along_axis(wanted, few, near, axis=1)
                wanted &= high >= low[:, None]
                wanted[np.arange(len(home)), home] = False
                r, c = np.nonzero(wanted)
                if len(r):
                    at = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(np.int32)), *(batch.column(i).take(at) for i in (1, 2, 3))], ["shard", "id", "x", "floor"]
                    )

        return asked.select("shard", "id", "x", "floor").mapInArrow(run, "shard int, id bigint, x array<int>, floor double")

    def run(batches):
        tree, held, shard = None, [], None
        for batch in batches:
            asks = np.asarray(batch.column(1))
            own = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (asks[1:] != asks[:-1])) + 1), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if own[a] != shard:
                    tree, held, shard = None, [], own[a]
                if asks[a] == 0:
                    held.append(part)
                    continue
                if tree is None and held:
                    x = _matrix([v for p in held for v in p.column(3).to_pylist()], width)
                    tree = BallTree(x, np.concatenate([np.asarray(p.column(2)) for p in held]))
                    held = []
                if tree is None:
                    continue
                for i in range(0, part.num_rows, QUERIES_AT_ONCE):
                    ask = part.slice(i, QUERIES_AT_ONCE)
                    ids = np.asarray(ask.column(2))
                    q = _matrix(ask.column(3).to_pylist(), width)
                    floor = np.array([-np.inf if f is None else f for f in ask.column(4).to_pylist()])
                    score, found = tree.search(q, ids, floor, k)
                    r, c = np.nonzero(np.isfinite(score))
                    # A query is named by id and vector, since ids may repeat.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[r]), ask.column(3).take(pa.array(r)), pa.array(found[r, c]), pa.array(score[r, c].astype(np.int64))],
                        ["query_id", "x", "id", "score"],
                    )

    def searched(asked: DataFrame) -> DataFrame:
        dealt = candidates.union(asked.select("shard", F.lit(1).alias("asks"), "id", "x", "floor"))
        dealt = dealt.repartition("shard").sortWithinPartitions("shard", "asks")
        return dealt.mapInArrow(run, "query_id bigint, x array<int>, id bigint, score bigint")

    best = Window.partitionBy("query_id", "x").orderBy(F.desc("score"), F.asc("id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def with_floor(found: DataFrame) -> DataFrame:
        """The queries with their kth score so far, null if fewer were found."""
        kth = found.groupBy("query_id", "x").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("n"))
        return queries.join(kth, (queries["id"] == kth["query_id"]) & (queries["x"] == kth["x"]), "left").select(
            queries["shard"], queries["id"], queries["x"], F.when(F.col("n") >= k, F.col("low")).alias("floor")
        )

    found = cut(searched(queries.select("shard", "id", "x", floor)))
    if shards > 1:
        found = cut(ranked(found.union(searched(route(with_floor(found), True)))).drop("rank"))
    if shards > 1 + NEAR:
        found = found.union(searched(route(with_floor(found), False)))
    if not rows.where("big is not null").isEmpty():
        found = found.select("query_id", F.transform("x", lambda c: c.cast("string")).alias("x"), "id", "score").union(_wide(rows, k, every))
    return ranked(found).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _wide(rows: DataFrame, k: int, every: int) -> DataFrame:
    """``query_id, x, id, score``: queries against vectors of large components, and queries of large components
    against all others, block by block in whole numbers of any size."""
    named = rows.select("id", F.coalesce("big", F.transform("x", lambda c: c.cast("string"))).alias("x"), F.col("big").isNotNull().alias("wide"))
    asked = named.where(F.col("id") % every == 0).dropDuplicates(["id", "x"])

    def scored(asks: DataFrame, held: DataFrame) -> DataFrame:
        parts = [max(1, -(-df.count() // WIDE_BLOCK)) for df in (asks, held)]
        mine = [F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int") for n in parts]
        every_one = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in parts]
        keyed = [
            df.withColumn("own", own).withColumn("other", other).select(
                F.concat_ws("/", *(("own", "other") if side == 0 else ("other", "own"))).alias("key"), F.lit(side).alias("side"), "id", "x"
            )
            for side, df, own, other in ((0, asks, mine[0], every_one[1]), (1, held, mine[1], every_one[0]))
        ]

        def run(batches):
            for g in groups(batches, "key"):
                side = np.asarray(g.column("side"))
                ids, x = np.asarray(g.column("id")), [list(map(int, v)) for v in g.column("x").to_pylist()]
                width = max(map(len, x))
                q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(q) or not len(c):
                    continue
                products = _padded([x[i] for i in q], width) @ _padded([x[i] for i in c], width).T
                out = []
                for i, row in zip(q, products):
                    row = [max(-LONG - 1, min(LONG, int(s))) for s in row]
                    order = sorted((n for n in range(len(c)) if ids[c[n]] != ids[i]), key=lambda n: (-row[n], ids[c[n]]))[:k]
                    out += [(int(ids[i]), g.column("x")[int(i)].as_py(), int(ids[c[n]]), row[n]) for n in order]
                if out:
                    a, b, e, d = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.list_(pa.string())), pa.array(e, pa.int64()), pa.array(d, pa.int64())], ["query_id", "x", "id", "score"])

        dealt = keyed[0].union(keyed[1]).repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(run, "query_id bigint, x array<string>, id bigint, score bigint")

    return scored(asked, named.where("wide")).union(scored(asked.where("wide"), named.where("not wide")))
