"""Connected components of a distributed set of links, and rows grouped by key within a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, nothing_left

#: Keys that are looked at for being heavy, and counters of the sketch that finds them: at a share of
#: 1 / HEAVY of all rows a key is always among them.
HEAVY, COUNTERS = 1000, 1 << 14


def heavy_keys(df: DataFrame, key: str) -> list[int]:
    """Hashes (``xxhash64``) of the keys of at least one in ``HEAVY`` rows, so at most so many, by a sketch of fixed size."""
    with nothing_left(df.sparkSession):
        row = df.agg(F.count("*").alias("rows"), F.expr(f"approx_top_k(xxhash64({key}), {HEAVY}, {COUNTERS})").alias("top")).first()
    return [r["item"] for r in row["top"] if r["count"] * HEAVY >= row["rows"]]


def is_heavy(key: str, heavy: list[int]) -> Column:
    return F.xxhash64(key).isin(heavy) if heavy else F.lit(False)


def keyed_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that ``right`` has once.

    Rows of heavy keys stay where they are and get their partner by broadcast, at most ``HEAVY`` rows
    whatever the size of the data; all others are joined by shuffle.  So a key of many rows gathers in
    no task.
    """
    heavy = heavy_keys(left, key)
    if not heavy:
        return left.join(right, key)
    big = is_heavy(key, heavy)
    return left.where(~big).join(right.where(~big), key).unionByName(left.where(big).join(F.broadcast(right.where(big)), key))


def _state(links: DataFrame) -> tuple:
    """What tells one round's links from another's."""
    with nothing_left(links.sparkSession):
        row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """Rows ``node, root`` for every node of ``links`` (columns a, b); root is the smallest node.

    Every round first ties the larger neighbours of each node to its smallest one, then the
    smaller neighbours, and ends when the links are stars.  Links stay distributed, those of a node of very
    many are joined where they are; each round is cut off in the checkpoint folder.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # The centre of a large group has a link to each of its nodes.
        larger = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = cut(keyed_join(larger, least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            keyed_join(large, least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links = cut(small)
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches of rows sorted by key."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows.column(key).combine_chunks()
        changed = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)) if len(keys) > 1 else pa.array([], pa.bool_())
        cuts = [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist()), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part, own = rows.slice(a, b - a), keys[a].as_py()
            if held and own != held_key:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            held_key = own
    if held:
        yield pa.concat_tables(held)
