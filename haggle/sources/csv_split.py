"""Large CSV files on many tasks, quoted fields of several lines included.

Spark reads the lines of a file block by block.  Whether a line begins inside a quoted field depends on all lines
before it, but only through one bit: so each block is followed from both states at once, the blocks' outcomes
are put together in file order (a few bytes for each block), and then every block knows how it begins.  Records that
run over the end of a block are joined from their pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The places of a block's records lie together in the order of the file.
BLOCK_ROOM = 33
_closing = re.compile(r'(?:[^"]|"")*"(?!")')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the next line begins inside a quoted field.  A quote counts where a field begins; elsewhere it is a
    sign like any other."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            found = _closing.match(line, at)
            if found is None:
                return True
            at, inside = found.end(), False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _by_line(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
            yield (file, block), line


@dataclass
class Block:
    """What has been learned of a block of a file."""

    place: int  #: among all blocks, in the order of files and blocks
    inside: bool  #: whether it begins inside a field
    returns: bool  #: whether a carriage return belongs to the line ends of its file
    header: str | None  #: the first record of its file, for the first block of the first file


def block_states(lines: DataFrame) -> dict[tuple[str, int], Block]:
    """All blocks of the files, by file and place."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends, header, heading, out = None, (False, True), [], False, []

        def put() -> None:
            out.append((*held, *ends, header[0].endswith("\r"), "\n".join(header) if held[1] == 0 else None))

        for name, line in _by_line(batches):
            if name != held:
                if held is not None:
                    put()
                held, ends, header, heading = name, (False, True), [], True
            ends = tuple(ends_inside(line, e) for e in ends)
            if heading:
                header.append(line)
                heading = ends[0] and name[1] == 0
        if held is not None:
            put()
        if out:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "block", "outside", "inside", "returns", "header"])

    found = lines.mapInArrow(follow, "file string, block bigint, outside boolean, inside boolean, returns boolean, header string")
    # A row for each block of a file, as planning a scan lists them anyway, and one header.
    first = F.row_number().over(Window.partitionBy(F.col("header").isNull()).orderBy("file", "block"))
    rows = found.withColumn("header", F.when((first == 1) & F.col("header").isNotNull(), F.col("header"))).collect()
    blocks, file, inside, returns = {}, None, False, False
    for i, r in enumerate(sorted(rows, key=lambda r: (r["file"], r["block"]))):
        if r["file"] != file:
            file, inside, returns = r["file"], False, r["returns"]
        header = r["header"]
        if header is not None:
            header = header.removeprefix("\ufeff")
            header = header.replace("\r\n", "\n").removesuffix("\r") if returns else header
        blocks[r["file"], r["block"]] = Block(i, inside, returns, header)
        inside = r["inside"] if inside else r["outside"]
    return blocks


def records(lines: DataFrame, blocks: dict[tuple[str, int], Block]) -> DataFrame:
    """``file, ord, head, record``: the records of CSV files with their line ends inside fields, ``ord`` in file order;
    ``head`` marks each file's first."""
    sent = lines.sparkSession.sparkContext.broadcast(blocks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, inside, whole, returns, n, out = None, [], False, True, False, 0, []

        def put(closed: bool) -> None:
            nonlocal n
            # A piece: whether its record begins here, and whether it ends here.
            text = "\n".join(begun)
            first = held[1] == 0 and n == 0
            out.append((held[0], (sent.value[held].place << BLOCK_ROOM) + n, first, text.removeprefix("\ufeff") if first else text, whole, closed))
            n += 1

        for name, line in _by_line(batches):
            if name != held:
                if begun:
                    put(False)
                held, begun, n = name, [], 0
                inside, returns = sent.value[name].inside, sent.value[name].returns
                whole = not inside
            begun.append(line.removesuffix("\r") if returns else line)
            inside = ends_inside(line, inside)
            if not inside:
                put(True)
                begun, whole = [], True
            if len(out) >= 1000:
                yield _pieces(out)
                out.clear()
        if begun:
            put(False)
        if out:
            yield _pieces(out)

    pieces = lines.mapInArrow(cut, "file string, ord bigint, head boolean, record string, opened boolean, closed boolean")
    complete = pieces.where("opened and closed").select("file", "ord", "head", "record")
    # Two pieces of a block at most are not complete.  A field that is never closed ends with its file.
    parts = pieces.where("not (opened and closed)")
    number = F.sum(F.col("opened").cast("int")).over(Window.partitionBy("file").orderBy("ord"))
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(F.min("ord").alias("ord"), F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("ord", "record"))).alias("all"))
    return complete.unionByName(joined.select("file", "ord", "head", F.array_join(F.transform("all", lambda p: p["record"]), "\n").alias("record")))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "ord", "head", "record", "opened", "closed"])


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``fields map<string,string>, ord``: the rows of CSV files as texts, by the names in the first file's header, ``ord`` in
    the order of files and rows.

    Empty lines go; a field that is never closed ends with its file.  Files whose lines end in carriage returns alone
    cannot be read in parts and are read as a whole."""
    lines = _lines(spark, path)
    blocks = block_states(lines)
    header = next((b.header for b in blocks.values() if b.header is not None), None)
    if header is None:
        return spark.createDataFrame([], "fields map<string,string>, ord bigint")
    if "\r" in header:
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        return rows.select(_fields(rows.columns, lambda n: F.col(f"`{n}`")), F.monotonically_increasing_id().alias("ord"))
    # Spark reads the header as it always does: doubled names are told apart, missing ones numbered.
    names = spark.read.csv(spark.sparkContext.parallelize([header], 1), header=True, escape='"').columns
    shape = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records(lines, blocks).where("not head and record <> ''").select("ord", F.from_csv("record", shape, {"escape": '"'}).alias("r"))
    return rows.select(_fields(names, lambda n: F.col("r").getField(n)), "ord")


def _fields(names: list[str], value) -> Column:
    return F.create_map(*(x for n in names for x in (F.lit(n), value(n)))).alias("fields")
