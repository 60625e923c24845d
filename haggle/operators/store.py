"""The product store: two append-only Parquet tables in a folder that all workers share."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.operators.filters import ascii_lower, search, violations
from haggle.operators.ledger import Ledger
from haggle.operators.reduce import keep_first_unless_null
from haggle.operators.summary import source_summary

PRODUCTS = (
    "id bigint, product_name string, price double, original_price double, shipping_fee double, currency string, category string, seller string, "
    "platform string, product_url string, image_url string, condition string, region string, detail_description string, source_url string, "
    "source_license string, source_observed_at timestamp, collected_at timestamp, data_source string"
)
RUNS = (
    "id bigint, source_name string, platform string, status string, product_count bigint, response_time_ms double, error_message string, started_at timestamp"
)


def new_rows(batch: DataFrame, stored: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of a batch whose key is not stored yet, the first of each key; rows without a key all pass."""
    first = keep_first_unless_null(batch, key, order)
    known = stored.where(F.col(key).isNotNull()).select(F.col(key).alias("_known"))
    return first.join(known, first[key] == F.col("_known"), "left_anti")


#: Columns that a search looks through.
SEARCHED = ("product_name", "category", "seller", "data_source")
#: Tries of a commit while other writers go first.
TRIES = 20


def grams_of(query: str) -> list[str]:
    """The runs of three letters that a text must hold to match a search; none where its parts are shorter."""
    low = query.translate({c: c + 32 for c in range(65, 91)})
    return sorted({run[i : i + 3] for run in re.split("[%_]", low) for i in range(len(run) - 2)})


class ProductStore:
    """Append, list, search and summarise stored products and the run log.

    Rows lie in folders that commits of a ledger name.  An append evaluates its rows once, into staged files;
    they are checked and numbered from the files, whose rows keep their places whatever happens to a worker, and the
    commit makes them visible.  Several writers may append: one that comes second reads the first one's commit,
    looks for known links again and numbers its rows behind it.  A batch with a name is stored once.

    Products are bucketed by the hash of their link, so a batch looks for its links without moving stored rows.
    A posting table of runs of three letters tells a search which files can hold its text."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._ledgers = {t: Ledger(spark, f"{self.path}/{t}/_commits") for t in ("products", "collection_runs")}
        # A store keeps the number of buckets it was begun with.
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._table = f"haggle_products_{hashlib.md5(self.path.encode()).hexdigest()}"
        self._listed = 0

    @property
    def buckets(self) -> int:
        first = self._ledgers["products"].entries()[:1]
        return first[0]["buckets"] if first else self._buckets

    def _bucketed(self) -> DataFrame:
        """All committed products with ``link_key``, as a bucketed table of the session's catalog."""
        entries = self._ledgers["products"].entries()
        if not entries:
            return self.spark.createDataFrame([], f"{PRODUCTS}, link_key bigint")
        if not self._listed:
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._table} ({PRODUCTS}, link_key bigint, folder string) USING parquet PARTITIONED BY (folder) "
                f"CLUSTERED BY (link_key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/products/data'"
            )
        new = [e["folder"] for e in entries[self._listed :]]
        for at in range(0, len(new), 1000):
            added = " ".join(f"PARTITION (folder = '{f}') LOCATION '{self.path}/products/data/{f}'" for f in new[at : at + 1000])
            self.spark.sql(f"ALTER TABLE {self._table} ADD IF NOT EXISTS {added}")
        self._listed = len(entries)
        return self.spark.table(self._table).drop("folder")

    @property
    def products(self) -> DataFrame:
        return self._bucketed().drop("link_key")

    @property
    def runs(self) -> DataFrame:
        folders = [f"{self.path}/collection_runs/data/{e['folder']}" for e in self._ledgers["collection_runs"].entries()]
        return self.spark.read.schema(RUNS).parquet(*folders) if folders else self.spark.createDataFrame([], RUNS)

    def unknown(self, batch: DataFrame, order: list) -> DataFrame:
        """Rows of a batch whose link is not stored yet, the first of each link; rows without a link all pass."""
        first = keep_first_unless_null(batch, "product_url", order).withColumn("_key", F.xxhash64("product_url"))
        stored = self._bucketed().where("product_url is not null").select("link_key", F.col("product_url").alias("_known"))
        # Only the hash is a key of the join, so that the buckets serve; equal hashes are told apart by the link.
        same = (first["_key"] == stored["link_key"]) & F.coalesce(first["product_url"] == stored["_known"], F.lit(False))
        linked = first.where("product_url is not null").join(stored, same, "left_anti")
        return linked.unionByName(first.where("product_url is null")).drop("_key")

    def _stage(self, rows: DataFrame, folder: str, order: list[str]) -> DataFrame:
        """Rows written down in order, read back."""
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        placed.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _numbered(self, staged: DataFrame, last: int) -> tuple[DataFrame, dict]:
        """Staged rows with ids behind ``last``, by their files and places; how many they are, and between which
        microseconds they were collected."""
        time = F.unix_micros("collected_at") if "collected_at" in staged.columns else F.lit(0)
        placed = staged.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        # A file comes from one task, so files are as few as tasks.
        files = placed.groupBy("_file").agg(F.count("*").alias("n"), F.min(time).alias("low"), F.max(time).alias("high")).collect()
        sizes = {r["_file"]: r["n"] for r in files}
        shift, total = [], last
        for name in sorted(sizes, key=lambda f: (int(f.split("-")[1]), f)):
            shift.append((name, total))
            total += sizes[name]
        offsets = self.spark.createDataFrame(shift, "_file string, _shift bigint")
        return placed.join(F.broadcast(offsets), "_file").withColumn("id", F.col("_shift") + F.col("_row") + 1).drop("_file", "_row", "_shift"), {
            "rows": total - last, "low": min((r["low"] for r in files), default=None), "high": max((r["high"] for r in files), default=None)
        }

    def _write(self, table: str, rows: DataFrame, folder: str) -> None:
        data = f"{self.path}/{table}/data/{folder}"
        if table != "products":
            rows.write.parquet(data)
            return
        key = F.xxhash64(F.coalesce("product_url", F.concat(F.lit("\0"), F.col("id").cast("string"))))
        keyed = rows.withColumn("link_key", F.when(F.col("product_url").isNotNull(), F.xxhash64("product_url")).otherwise(key))
        name = f"haggle_stage_{uuid.uuid4().hex}"
        keyed.repartition(self.buckets, "link_key").write.format("parquet").bucketBy(self.buckets, "link_key").option("path", data).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        self._post(folder)

    def _post(self, folder: str) -> None:
        """``field, gram, file``: which runs of three letters each file of a folder holds."""
        rows = self.spark.read.schema(PRODUCTS).parquet(f"{self.path}/products/data/{folder}")
        texts = rows.select(F.concat(F.lit(f"{folder}/"), "_metadata.file_name").alias("file"), F.explode(F.create_map(*(x for c in SEARCHED for x in (F.lit(c), ascii_lower(F.col(c)))))).alias("field", "text"))
        long = texts.where(F.length("text") >= 3).distinct()
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring("text", i, F.lit(3))))
        found = long.select("file", "field", F.explode(grams).alias("gram")).distinct()
        found.repartitionByRange("gram").sortWithinPartitions("gram", "field", "file").write.parquet(f"{self.path}/products/grams/{folder}")

    def _append(self, table: str, rows: DataFrame, schema: str, order: list[str], batch: str | None = None, new_only: bool = False) -> DataFrame:
        ledger, shape = self._ledgers[table], self.spark.createDataFrame([], schema)
        done = ledger.find(batch)
        if done is None:
            stage = f"{self.path}/_stage/{uuid.uuid4().hex}"
            try:
                given = rows.select(*(c for c in rows.columns if c in shape.columns and c != "id"), *(c for c in order if c not in shape.columns))
                staged = self._stage(shape.drop("id").unionByName(given, allowMissingColumns=True), f"{stage}/rows", order)
                if table == "products":
                    bad = violations(staged).first()
                    if bad is not None:
                        raise ValueError(f"invalid product {bad['product_name']!r}: {bad['violation']}")
                for i in range(TRIES):
                    done = self._try(table, staged, f"{stage}/{i}", order, batch, new_only, shape.columns)
                    if done is not None:
                        break
                else:
                    raise RuntimeError(f"other writers were faster {TRIES} times")
            finally:
                ledger.delete(stage)
        stored = self.products if table == "products" else self.runs
        return stored.where((F.col("id") > done["before"]) & (F.col("id") <= done["before"] + done["rows"]))

    def _try(self, table: str, staged: DataFrame, stage: str, order: list[str], batch: str | None, new_only: bool, columns: list[str]) -> dict | None:
        """One attempt to commit staged rows; None if another writer was faster."""
        ledger = self._ledgers[table]
        entries = ledger.entries()
        done = ledger.find(batch)
        if done is not None:
            return done
        chosen = self._stage(self.unknown(staged, order), stage, order) if new_only and entries else staged
        if new_only and not entries:
            chosen = self._stage(keep_first_unless_null(staged, "product_url", order), stage, order)
        before = entries[-1]["before"] + entries[-1]["rows"] if entries else 0
        numbered, facts = self._numbered(chosen, before)
        folder = f"{len(entries) + 1:010d}-{uuid.uuid4().hex}"
        self._write(table, numbered.select(*columns), folder)
        entry = {"folder": folder, "batch": batch, "before": before, "buckets": self.buckets, **facts}
        if ledger.commit(len(entries) + 1, entry):
            return entry
        for part in ("data", "grams"):
            ledger.delete(f"{self.path}/{table}/{part}/{folder}")
        return None

    def _ready(self, products: DataFrame) -> DataFrame:
        now = F.coalesce("collected_at", F.current_timestamp()) if "collected_at" in products.columns else F.current_timestamp()
        ready = products.withColumn("collected_at", now)
        for c, value in (("currency", "KRW"), ("condition", "unknown")):
            ready = ready.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in products.columns else F.lit(value))
        return ready

    def add(self, products: DataFrame, order: tuple[str, ...] = (), batch: str | None = None) -> DataFrame:
        """Append all products; an invalid one fails the whole call before anything is stored.

        Returns the stored rows.  A batch of a name that is stored already is not stored again."""
        return self._append("products", self._ready(products), PRODUCTS, list(order), batch)

    def add_new(self, products: DataFrame, order: tuple[str, ...], batch: str | None = None) -> DataFrame:
        """Append products whose link is not stored yet; products without a link always, but once in a named batch."""
        return self._append("products", self._ready(products), PRODUCTS, list(order), batch, new_only=True)

    def record(self, source_name: str, platform: str, status: str, product_count: int = 0, response_time_ms: float | None = None, error_message: str | None = None, started_at=None) -> DataFrame:
        row = [(source_name, platform, status, product_count, response_time_ms, error_message, started_at)]
        schema = "source_name string, platform string, status string, product_count bigint, response_time_ms double, error_message string, started_at timestamp"
        run = self.spark.createDataFrame(row, schema).withColumn("started_at", F.coalesce("started_at", F.current_timestamp()))
        return self._append("collection_runs", run, RUNS, [])

    @staticmethod
    def _newest() -> list[Column]:
        return [F.desc("collected_at"), F.desc("id")]

    def list(self, limit: int = 50, offset: int = 0, platform: str | None = None, data_source: str | None = None, after: tuple | None = None) -> DataFrame:
        """Products from the newest on.  ``after`` is the (collected_at, id) of the row before a page: such a page reads
        the commits that can hold it alone, however deep it lies, where ``offset`` reads all rows before it."""
        if not 1 <= limit <= 200 or offset < 0:
            raise ValueError("limit is 1 to 200, offset 0 or more")
        filtered = bool(platform or data_source)
        rows = self.products if after is None and (filtered or offset) else self._page(after, None if filtered else limit + offset)
        if platform:
            rows = rows.where(F.col("platform") == platform)
        if data_source:
            rows = rows.where(F.col("data_source") == data_source)
        return rows.orderBy(*self._newest()).offset(offset).limit(limit)

    def _page(self, after: tuple | None, n: int | None) -> DataFrame:
        """Products behind ``after`` of the commits among which the first ``n`` lie, or all of them."""
        entries = [e for e in self._ledgers["products"].entries() if e["rows"]]
        behind = F.lit(True)
        if after is not None:
            key = self.spark.createDataFrame([after], "time timestamp, id bigint")
            at = key.select(F.unix_micros("time")).first()[0]
            entries = [e for e in entries if e["low"] <= at]
            micros = F.unix_micros("collected_at")
            behind = (micros < at) | ((micros == at) & (F.col("id") < after[1]))
        if n is not None:
            # The latest commits that lie behind the key as a whole and have enough rows; older ones add none.
            have, lowest = 0, None
            for e in sorted((e for e in entries if after is None or e["high"] < at), key=lambda e: -e["low"]):
                have, lowest = have + e["rows"], e["low"]
                if have >= n:
                    entries = [x for x in entries if x["high"] >= lowest]
                    break
        folders = [f"{self.path}/products/data/{e['folder']}" for e in entries]
        rows = self.spark.read.schema(PRODUCTS).parquet(*folders) if folders else self.spark.createDataFrame([], PRODUCTS)
        return rows.where(behind)

    def search(self, query: str, limit: int = 50) -> DataFrame:
        if not query or not 1 <= limit <= 200:
            raise ValueError("a query is needed, and a limit of 1 to 200")
        return search(self.searched(query), query).orderBy(*self._newest()).limit(limit)

    def searched(self, query: str) -> DataFrame:
        """Products of the files that can hold a search's text: all of its runs of three letters in one field."""
        grams, entries = grams_of(query), self._ledgers["products"].entries()
        if not grams or not entries:
            return self.products
        posted = self.spark.read.parquet(*(f"{self.path}/products/grams/{e['folder']}" for e in entries)).where(F.col("gram").isin(grams))
        whole = posted.groupBy("field", "file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
        # A list of files, which planning their scan holds on the driver anyway.
        files = sorted(f"{self.path}/products/data/{r['file']}" for r in whole.select("file").distinct().collect())
        return self.spark.read.schema(PRODUCTS).parquet(*files) if files else self.spark.createDataFrame([], PRODUCTS)

    def sources(self) -> DataFrame:
        return source_summary(self.products, self.runs).orderBy("data_source")
