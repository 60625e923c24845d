"""Mixing sources to target weights by Pfair scheduling.

The documents of each source, in a fixed random order, are cut into blocks, and a stream of slots
takes one block each.  With weight w of a total W, block i of a source (from 1) is released at
slot floor((i-1) W/w) and due by slot ceil(i W/w); the released block of the earliest deadline
goes first.  At every slot each source then has had its share to within less than one block.  The
schedule repeats after W slots, so one period is laid out and blocks are placed by arithmetic.
When a source runs out, a new phase begins among the others, so every document is placed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents of one source that one task numbers at most, about.
NUMBERED_AT_ONCE = 20_000
#: Rows up to which the schedule is sent to all workers.
BROADCAST_ROWS = 100_000


def period(weights: dict) -> dict:
    """The slots of one period that each source gets, by earliest deadline first."""
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s) for s, w in weights.items()]
    heapq.heapify(waiting)
    released: list = []
    slots: dict = {s: [] for s in weights}
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(released, (due, s))
        _, s = heapq.heappop(released)
        slots[s].append(now)
        done = len(slots[s])
        if done < weights[s]:
            heapq.heappush(waiting, (done * total // weights[s], -(-(done + 1) * total // weights[s]), s))
    return slots


@dataclass
class Phase:
    start: int  # first slot
    total: int  # slots of one period
    first: dict  # source -> number of its first block in the phase
    last: dict  # source -> number after its last block
    slots: dict


def schedule(blocks: dict, weights: dict) -> list[Phase]:
    """Phases that place all ``blocks`` (source -> number of blocks)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, phases = 0, []
    while left:
        slots = period({s: weights[s] for s in left})
        total = sum(weights[s] for s in left)
        ends = {s: (n - 1) // weights[s] * total + slots[s][(n - 1) % weights[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        taken = {
            s: length // total * weights[s] + sum(1 for x in slots[s] if x < length % total) for s in left
        }
        phases.append(Phase(start, total, {s: done[s] for s in left}, {s: done[s] + taken[s] for s in left}, slots))
        for s in taken:
            done[s] += taken[s]
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
        start += length
    return phases


def mix(docs: DataFrame, weights: dict[str, int], default: int = 1, block: int = 64, id_col: str = "doc_id", source_col: str = "source", keep: bool = False) -> DataFrame:
    """Place every document in the mixed stream.

    Rows ``id_col, source_col, block, slot, place, position`` (with ``keep``: all columns of
    ``docs``, sorted by position and nothing else).  ``weights`` are positive whole numbers; a
    source without one has ``default``, so has the null source, which is one source.  Inside a
    source documents follow a hash of id and text; equal rows are in either order; null texts and
    ids are like any other value.  The last block of a source may be short.  An empty table gives
    an empty table.  The number of sources, not of rows, bounds what the driver holds.
    """
    spark = docs.sparkSession
    if any(w < 1 for w in (*weights.values(), default)):
        raise ValueError("weights are positive whole numbers")
    kept = docs.columns
    hashed = F.xxhash64(F.col(id_col), F.col("text")) if "text" in kept else F.xxhash64(F.col(id_col))
    named = docs.select(F.struct(*(docs[c] for c in (kept if keep else [id_col, source_col]))).alias("d"), F.col(source_col).cast("string").alias("s"), hashed.alias("h"))
    # A prefix tells the null source from a source named alike.
    named = named.withColumn("s", F.when(F.col("s").isNull(), "-").otherwise(F.concat(F.lit("+"), "s")))
    counted = named.groupBy("s").count().collect()
    sizes = {r["s"]: r["count"] for r in counted}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // NUMBERED_AT_ONCE))
    cell = named.withColumn("cell", F.pmod(F.shiftright("h", 8), F.lit(parts)).cast("int"))
    before = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cell.groupBy("s", "cell").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("s", "cell", "before")
    )
    inner = Window.partitionBy("s", "cell").orderBy("h", F.col(f"d.{id_col}"))
    small = len(sizes) * parts <= BROADCAST_ROWS
    numbered = (
        cell.withColumn("n", F.row_number().over(inner) - 1)
        .join(F.broadcast(offsets) if small else offsets, ["s", "cell"])
        .withColumn("n", F.col("n") + F.col("before"))
        .select("d", "s", F.floor(F.col("n") / block).cast("bigint").alias("block"), (F.col("n") % block).alias("place"))
    )
    weight = {s: weights.get(s[1:], default) if s[0] == "+" else default for s in sizes}
    phases = schedule({s: -(-n // block) for s, n in sizes.items()}, weight)
    # Block b of source s in a phase is the one of this period whose number it shares.
    rows = [
        (s, p.first[s], p.last[s], p.start, p.total, weight[s], p.slots[s]) for p in phases for s in p.first if p.last[s] > p.first[s]
    ]
    layout = spark.createDataFrame(rows, "s string, first long, last long, start long, total long, w long, slots array<int>")
    if len(rows) * max([1, *weight.values()]) <= BROADCAST_ROWS:
        layout = F.broadcast(layout)
    i = F.col("block") - F.col("first")
    slot = F.col("start") + F.floor(i / F.col("w")) * F.col("total") + F.element_at("slots", (i % F.col("w") + 1).cast("int"))
    placed = numbered.join(layout, "s").where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("last"))).withColumn("slot", slot.cast("bigint"))
    if keep:
        # Slots are taken evenly, so partition numbers follow from them without sampling.
        deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
        slots = max([1, *(p.start + -(-(p.last[s] - p.first[s]) // weight[s]) * p.total for p in phases for s in p.first)])
        deal = F.least(F.floor(F.col("slot") * deals / slots), F.lit(deals - 1)).cast("int")
        ordered = placed.repartitionById(deals, deal).sortWithinPartitions("slot", "place")
        return ordered.select(*(F.col("d").getField(c).alias(c) for c in kept))
    return placed.select(
        F.col(f"d.{id_col}").alias(id_col), F.col(f"d.{source_col}").alias(source_col), "block", "slot", F.col("place").cast("bigint").alias("place"),
        _position(phases, sizes, block).alias("position"),
    )


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` as :func:`mix` with ``keep`` left it, with its ``position`` (from 0), dealt out and sorted by it.

    Read back from one Parquet write, rows stand in the order of the files' task numbers and inside a
    file in that of its rows, whatever order the files are scanned in; other DataFrames are taken
    in the order of their partitions.  A column named ``position`` is replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "position"]
    try:
        file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        docs.select(file, row).schema  # noqa: B018
        number = lambda pattern: F.coalesce(F.regexp_extract(file, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))
        placed = docs.select(F.struct(*(docs[c] for c in kept)).alias("d"), number("^part-([0-9]+)").alias("task"), number("-c([0-9]+)[.]").alias("piece"), file.alias("file"), row.alias("row"))
    except AnalysisException:
        row = F.monotonically_increasing_id()
        held = cut(docs.select(F.struct(*(docs[c] for c in kept)).alias("d"), row.alias("row")))
        placed = held.select("d", F.shiftright("row", 33).alias("task"), F.lit(0).cast("bigint").alias("piece"), F.lit("").alias("file"), (F.col("row") % (1 << 33)).alias("row"))
    sizes = sorted((r["task"], r["piece"], r["file"], r["count"]) for r in placed.groupBy("task", "piece", "file").count().collect())
    starts, total = [], 0
    for task, piece, file, n in sizes:
        starts.append((task, piece, file, total))
        total += n
    first = spark.createDataFrame(starts, "task bigint, piece bigint, file string, first bigint")
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = placed.join(F.broadcast(first), ["task", "piece", "file"]).withColumn("position", F.col("first") + F.col("row"))
    deal = F.least(F.floor(F.col("position") * deals / max(total, 1)), F.lit(deals - 1)).cast("int")
    ordered = found.select("d", "position").repartitionById(deals, deal).sortWithinPartitions("position")
    return ordered.select(*(F.col("d").getField(c).alias(c) for c in kept), "position")


def _position(phases: list[Phase], sizes: dict, block: int) -> Column:
    """Documents before one: full blocks up to its slot, less what short blocks before it lack."""
    lacking = []
    for p in phases:
        for s in p.first:
            number = -(-sizes[s] // block) - 1
            if sizes[s] % block and p.first[s] <= number < p.last[s]:
                i = number - p.first[s]
                w = len(p.slots[s])
                lacking.append((p.start + i // w * p.total + p.slots[s][i % w], block - sizes[s] % block))
    position = F.col("slot") * block + F.col("place")
    if lacking:
        short = F.array(*(F.struct(F.lit(at).cast("bigint").alias("at"), F.lit(n).cast("bigint").alias("n")) for at, n in lacking))
        slot = F.col("slot")
        position = position - F.aggregate(short, F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["at"] < slot, x["n"]).otherwise(0))
    return position.cast("bigint")
