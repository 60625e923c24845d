"""Large JSON lists on many tasks.

Spark reads a file cut at every closing brace, block by block.  What a block means depends on the brackets that are open
before it and on whether it begins inside a string: so each block is followed from both states of a string, what it
closes and leaves open is noted, and the blocks' notes are put together in file order.  Then every block knows the
brackets it begins in, and list elements that run over its end are joined from their pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROOM = 33
UNSUPPORTED = "unsupported JSON import shape"
#: A string with its closing quote where it has one, or a bracket; a closing brace ends the row instead.
_token = re.compile(r'"((?:[^"\\]|\\.)*)("?)|([\[\]{])', re.S)
_rest = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_colon = re.compile(r"\s*:\s*\Z")


@dataclass
class Reader:
    """The brackets that are open, each with the key it stands under, and whether a string is."""

    inside: bool = False
    stack: list[tuple[str, str]] = field(default_factory=list)
    closed: int = 0  #: brackets closed that were open before

    def pop(self) -> None:
        if self.stack:
            self.stack.pop()
        else:
            self.closed += 1

    def brackets(self, row: str) -> Iterator[tuple[str, int]]:
        """Each bracket of a row with its place, after the stack has followed it; the brace at the row's end last."""
        at, key, behind = 0, "", -1
        if self.inside:
            end = _rest.match(row)
            if end is None:
                return
            at, self.inside = end.end(), False
        for t in _token.finditer(row, at):
            bracket = t[3]
            if bracket is None:
                if not t[2]:
                    self.inside = True
                    return
                key, behind = t[1], t.end()
                continue
            if bracket == "]":
                self.pop()
            else:
                named = behind >= 0 and _colon.match(row[behind : t.start()])
                self.stack.append((bracket, key if named else ""))
            yield bracket, t.start()
        self.pop()
        yield "}", len(row)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("row"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, block, row in zip(*(c.to_pylist() for c in batch.columns)):
            yield (file, block), row


def block_starts(rows: DataFrame) -> dict[tuple[str, int], tuple[int, Reader]]:
    """For each block its place among all blocks, in the order of files and blocks, and how it begins."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, readers, out = None, (), []

        def put() -> None:
            for start, r in enumerate(readers):
                out.append((*held, start == 1, r.inside, r.closed, [b for b, _ in r.stack], [k for _, k in r.stack]))

        for name, row in _each(batches):
            if name != held:
                if held is not None:
                    put()
                held, readers = name, (Reader(), Reader(True))
            for r in readers:
                for _ in r.brackets(row):
                    pass
        if held is not None:
            put()
        if out:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "block", "start", "inside", "closed", "brackets", "keys"])

    # Two rows for each block of a file, as planning a scan lists them anyway; a block leaves few brackets open.
    notes = rows.mapInArrow(follow, "file string, block bigint, start boolean, inside boolean, closed bigint, brackets array<string>, keys array<string>").collect()
    by_block = {(r["file"], r["block"], r["start"]): r for r in notes}
    starts, file, now = {}, None, Reader()
    for i, (name, block) in enumerate(sorted({(r["file"], r["block"]) for r in notes})):
        if name != file:
            file, now = name, Reader()
        starts[name, block] = (i, now)
        r = by_block[name, block, now.inside]
        kept = now.stack[: max(0, len(now.stack) - r["closed"])]
        now = Reader(r["inside"], [*kept, *zip(r["brackets"], r["keys"])])
    return starts


def list_elements(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """``file, ord, element``: the objects of the list that a file is, or of the first of ``keys`` that holds a list in the
    object that it is; ``ord`` in file order.  Elements that are no objects go; a file without such a list is an error."""
    rows = _rows(spark, path)
    starts = block_starts(rows)
    if not starts:
        raise ValueError(UNSUPPORTED)
    sent = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader, begun, whole, n, out = None, Reader(), None, True, 0, []

        def lists() -> str | None:
            """The key of the list that elements stand in, if the open brackets lead into one."""
            s = reader.stack
            if s and s[0][0] == "[":
                return ""
            return s[1][1] if len(s) > 1 and s[1][0] == "[" and s[1][1] in keys else None

        def base() -> int:
            return 1 if reader.stack and reader.stack[0][0] == "[" else 2

        def put(key: str, closed: bool) -> None:
            nonlocal n
            out.append((held[0], (sent.value[held][0] << BLOCK_ROOM) + n, key, "}".join(begun) if begun is not None else None, whole, closed))
            n += 1

        for name, row in _each(batches):
            if name != held:
                if begun is not None:
                    put(lists() or "", False)
                held, n = name, 0
                start = sent.value[name][1]
                reader = Reader(start.inside, list(start.stack))
                inside = lists() is not None and len(reader.stack) > base() and reader.stack[base()][0] == "{"
                begun, whole = ([], False) if inside else (None, True)
            if begun is not None:
                begun.append(row)
            for bracket, at in reader.brackets(row):
                key = lists()
                depth = len(reader.stack)
                if bracket == "[" and key is not None and depth == base():
                    whole = True
                    put(key, True)  # a list is told even if it holds nothing
                elif bracket == "{" and key is not None and depth == base() + 1 and begun is None:
                    begun, whole = [row[at:]], True
                elif bracket == "}" and key is not None and depth == base() and begun is not None:
                    begun.append("")
                    put(key, True)
                    begun, whole = None, True
            if len(out) >= 1000:
                yield _pieces(out)
                out.clear()
        if begun is not None:
            put(lists() or "", False)
        if out:
            yield _pieces(out)

    pieces = rows.mapInArrow(cut, "file string, ord bigint, key string, element string, opened boolean, closed boolean")
    complete = pieces.where("opened and closed").select("file", "ord", "key", "element")
    # Two pieces of a block at most are not complete.
    parts = pieces.where("not (opened and closed)")
    number = F.sum(F.col("opened").cast("int")).over(Window.partitionBy("file").orderBy("ord"))
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(F.min("ord").alias("ord"), F.max_by("key", "ord").alias("key"), F.array_sort(F.collect_list(F.struct("ord", "element"))).alias("all"))
    every = complete.unionByName(joined.select("file", "ord", "key", F.array_join(F.transform("all", lambda p: p["element"]), "}").alias("element")))
    rank = F.when(F.col("key") == "", len(keys))
    for i, k in enumerate(keys):
        rank = rank.when(F.col("key") == k, i)
    chosen = every.groupBy("file").agg(F.min(rank).alias("_rank"))
    files = spark.createDataFrame([(f,) for f in sorted({f for f, _ in starts})], "file string")
    told = files.join(chosen, "file", "left").join(every, "file", "left")
    fits = F.when(F.col("_rank").isNull(), F.raise_error(F.lit(UNSUPPORTED)).cast("boolean")).otherwise((rank == F.col("_rank")) & F.col("element").isNotNull())
    return told.where(fits).select("file", "ord", "element")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "ord", "key", "element", "opened", "closed"])
