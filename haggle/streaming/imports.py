"""The idempotent import and the latest run of each source, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from haggle.operators.store import ProductStore
from haggle.operators.summary import latest_run


def import_stream(products: DataFrame, store: ProductStore, checkpoint: str, order: tuple[str, ...] = ("product_url",), available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch's products whose link is not stored yet.

    A micro-batch is stored under the name of the stream's checkpoint and its number, so one that is replayed after a
    failure adds nothing twice, products without a link included."""

    def add(batch: DataFrame, number: int) -> None:
        store.add_new(batch, order, f"{checkpoint}#{number}")

    writer = products.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def unique_links(products: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each link once within the watermark, without a store to ask."""
    return products.withWatermark("collected_at", delay).dropDuplicatesWithinWatermark(["product_url"])


def latest_run_stream(runs: DataFrame) -> DataFrame:
    """Each source's latest run so far; state is one row for each source."""
    return latest_run(runs)


class LatestRun(StatefulProcessor):
    """Keeps a source's last run, by start and then id; a source that is silent for ``keep_ms`` is forgotten."""

    FIELDS = "started_at timestamp, id bigint, status string, response_time_ms double, error_message string"

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.FIELDS)

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        best = self.last.get() if self.last.exists() else None
        found = None
        for frame in rows:
            for run in frame[["started_at", "id", "status", "response_time_ms", "error_message"]].itertuples(index=False, name=None):
                at, number = run[0].to_pydatetime(), int(run[1])
                if best is None or (at, number) > (best[0], best[1]):
                    best = found = (at, number, *(None if pd.isna(v) else v for v in run[2:]))
        if found is not None:
            self.last.update(found)
            if self.keep_ms is not None:
                for old in self.handle.listTimers():
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.keep_ms)
            yield pd.DataFrame({"data_source": [key[0]], "last_started_at": [found[0]], "last_id": [found[1]], "last_status": [found[2]], "last_response_time_ms": [found[3]], "last_error_message": [found[4]]})

    def handleExpiredTimer(self, key, timer_values, expired_timer):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_run_updates(runs: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A row whenever a source's latest run changes: ``data_source, last_started_at, last_id, last_status,
    last_response_time_ms, last_error_message``.

    State is one run for each source, in the RocksDB state store, and goes on after a restart; with ``keep_ms`` a
    source without new runs for so long is dropped from it by a timer.  The last update of each source is what
    :func:`haggle.operators.summary.latest_run` gives."""
    shape = "data_source string, last_started_at timestamp, last_id bigint, last_status string, last_response_time_ms double, last_error_message string"
    return runs.groupBy("source_name").transformWithStateInPandas(LatestRun(keep_ms), shape, "Append" if keep_ms is None else "Update", "None" if keep_ms is None else "ProcessingTime")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_counts(runs: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs by source, status and time window, late ones within the delay included."""
    return runs.withWatermark("started_at", delay).groupBy(F.window("started_at", window), "source_name", "status").agg(F.count("*").alias("runs"))
