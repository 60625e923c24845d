"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from haggle.session import shared_folder, spread

#: Bytes of text that one vectorised step works on; it bounds a worker's memory.
PIECE_BYTES = 1 << 20

#: A query that is planned under this setting deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession, rows: int = 512, size: str = "4m") -> None:
    """Rows and bytes per Arrow batch: long texts make the default of 10,000 rows too large for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; one of the machine only where the session is local."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


@contextmanager
def nothing_left(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run inside leave no shuffle files, which otherwise stay until the driver happens
    to collect its garbage; over many rounds they come to more than the data."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it came about, shuffle files included."""
    ready_checkpoints(df.sparkSession)
    with nothing_left(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """``make()`` runs once per task and returns a function from a batch to columns in schema order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one by one; null reads as empty."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""
