"""Pages as a Spark data source: ``spark.read.format("pages")`` and ``spark.readStream.format("pages")``.

Addresses lie in an append-only log of Parquet files, which Spark writes (:class:`AddressLog`).  A batch of the log
has a folder for each lane; all addresses of a host are in one lane, and a lane is read by one task, one address
after the other with a pause between those of a host.  So a host never sees two requests at a time, and the
driver lists folders but no addresses.

Read as a table, the source fetches all batches of the log.  Read as a stream, batches are its offsets: a
micro-batch fetches what has been added since the last one, and a stream that starts again with its
checkpoint goes on behind the last batch it finished.
"""

from __future__ import annotations

import importlib
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from haggle.sources.fetch import FETCHED, Getter, fetched_row, host_of

LANES = 4096
#: Further lanes, for addresses that have no host.
HOSTLESS = 64
SCHEMA = f"url string, {FETCHED}"
BATCH = re.compile(r"batch-([0-9]{10})")
#: Pages handed to Spark together.
TOGETHER = 16


class AddressLog:
    """Addresses to fetch, batch after batch, in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, lanes: int = LANES):
        self.spark, self.path, self.lanes = spark, path.rstrip("/"), lanes

    def append(self, addresses: DataFrame) -> int:
        """Add ``url`` (and ``rendered``, whether a browser shows it) as the next batch; returns its number.

        Each address of a batch is fetched once; null and blank ones go.  A batch counts once it is whole."""
        rendered = F.coalesce(F.col("rendered"), F.lit(False)) if "rendered" in addresses.columns else F.lit(False)
        rows = addresses.select(F.trim("url").alias("url"), rendered.alias("rendered")).where("url <> ''").groupBy("url").agg(F.max("rendered").alias("rendered"))
        rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("lane", self._lane())
        number = max(finished(self.path), default=0) + 1
        rows.repartition("lane").sortWithinPartitions("lane", "host", "url").write.mode("overwrite").partitionBy("lane").parquet(f"{self.path}/batch-{number:010d}")
        return number

    def _lane(self):
        # An address without a host, as that of a file, has no host to be asked one at a time.
        alone = F.coalesce(F.col("host"), F.lit("")) == ""
        return F.when(alone, self.lanes + F.pmod(F.xxhash64("url"), F.lit(HOSTLESS))).otherwise(F.pmod(F.xxhash64("host"), F.lit(self.lanes)))


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def finished(path: str) -> list[int]:
    """Numbers of the whole batches of a log, in order."""
    from pyarrow import fs

    files, root = _files(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    numbers = {int(m[1]): i.path for i in found if (m := BATCH.fullmatch(i.base_name))}
    return sorted(n for n, p in numbers.items() if files.get_file_info(f"{p}/_SUCCESS").type == fs.FileType.File)


@dataclass
class Lane(InputPartition):
    """One lane's folders, in the order of their batches."""

    folders: tuple[str, ...]


def lanes(path: str, numbers: list[int]) -> list[Lane]:
    from pyarrow import fs

    files, root = _files(path)
    found: dict[str, list[str]] = {}
    for n in numbers:
        for i in files.get_file_info(fs.FileSelector(f"{root}/batch-{n:010d}")):
            if i.type == fs.FileType.Directory:
                found.setdefault(i.base_name, []).append(i.path)
    return [Lane(tuple(folders)) for _, folders in sorted(found.items())]


def _getter(name: str) -> Getter:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Fetcher:
    """What the table and the stream share: reading a lane."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the pages source needs the path of an address log")
        self.path = options["path"].rstrip("/")
        self.delay = float(options.get("delay", 1.0))
        # Getters are named, since a plan carries options only: "module:function".
        self.get, self.render = options.get("get", "haggle.sources.fetch:http_get"), options.get("render", "haggle.sources.fetch:browser_get")

    def read(self, partition: Lane) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset

        files, _ = _files(self.path)
        get, render = _getter(self.get), _getter(self.render)
        asked: dict[str, float] = {}
        held: list[tuple] = []
        for folder in partition.folders:
            # A task writes a lane in order of hosts; its files follow each other by name.
            for batch in dataset.dataset(folder, filesystem=files, format="parquet").to_batches(columns=["host", "url", "rendered"], batch_size=1024):
                for host, url, rendered in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if host in asked:
                        time.sleep(max(0.0, asked[host] + self.delay - time.monotonic()))
                    held.append((url, *fetched_row(url, render if rendered else get)))
                    asked[host] = time.monotonic()
                    if len(held) == TOGETHER:
                        yield _batch(held)
                        held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int32() if n == "http_status" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class PageReader(_Fetcher, DataSourceReader):
    def partitions(self) -> list[Lane]:
        return lanes(self.path, finished(self.path)) or [Lane(())]


class PageStreamReader(_Fetcher, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        return {"batch": max(finished(self.path), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        return lanes(self.path, [n for n in finished(self.path) if start["batch"] < n <= end["batch"]])


class PageSource(DataSource):
    """Options: ``path`` (the address log), ``delay`` (seconds between requests to a host), ``get`` and ``render``
    (getters by name).  A page that cannot be had is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("pages")`` known to a session."""
    spark.dataSource.register(PageSource)
