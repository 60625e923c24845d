"""One entry for all of the library: crawl, collect, import, and ask the store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.extract.frames import exploded, parse_pages
from haggle.operators.filters import access_error, eligible
from haggle.operators.reduce import aggregate_candidates
from haggle.operators.store import ProductStore
from haggle.operators.summary import benchmark_summary, candidate_summary, crawl_status, source_dashboard, summarize_products
from haggle.plans.crawl import crawl_products
from haggle.sources.files import as_products, file_rows, modified_at
from haggle.session import shared_folder
from haggle.sources.registry import search_url, select_sources, sources_frame

Collector = Callable[[str | None, int], DataFrame]


class Engine:
    """``collectors``: name -> (function of query and limit to products, platform, needs a key, configured)."""

    def __init__(self, spark: SparkSession, path: str, collectors: dict[str, tuple[Collector, str, bool, bool]] | None = None):
        self.spark, self.store, self.collectors = spark, ProductStore(spark, path), collectors or {}

    # -- crawl ------------------------------------------------------------------------------------------

    def requests(self, query: str, limit: int = 20, max_price: int | None = None, include_used: bool = False, source: str | None = None) -> DataFrame:
        """One row for each source to ask, with its search address; raises what a bad request raises."""
        if not query.strip() or limit < 1 or (max_price is not None and max_price < 0):
            raise ValueError("a query, a limit of 1 or more and a price of 0 or more are needed")
        chosen = [s.source for s in select_sources(include_used, source)]
        rules = sources_frame(self.spark)
        asked = rules.where(F.col("source").isin(chosen)) if chosen else rules.limit(0)
        return asked.select(
            "*", F.lit("r1").alias("request_id"), F.lit(query).alias("query"), F.lit(max_price).cast("bigint").alias("max_price"), F.lit(include_used).alias("include_used"),
            F.lit(limit).alias("limit"), search_url(F.col("source"), F.lit(query)).alias("page_url"),
        )

    def crawl(self, requests: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Products, page counters and the status of each request.

        ``pages``: source, html, title, http_status, render_error (null if fetched)."""
        # A handful of sources for each request.
        folder = shared_folder(self.spark, "crawl")
        parse_pages(pages.join(F.broadcast(requests), "source")).write.parquet(folder)
        # Parsed once: products, counters and status all read what was written.
        parsed = self.spark.read.parquet(folder)
        counters = parsed.select(
            "request_id", "source", "source_ord", "title", "http_status", "render_error", "parse_error", "stats.*",
            F.size(F.filter("candidates", lambda c: F.coalesce(c["image_url"], F.lit("")) != "")).alias("raw_image_candidate_count"),
            access_error(F.col("title"), F.col("http_status"), F.col("stats.html_length"), F.col("stats.total_link_count")).alias("access_error"),
        )
        blocked = counters.where("access_error is not null or render_error is not null").select("request_id", "source")
        usable = exploded(parsed.drop("http_status", "render_error")).join(blocked, ["request_id", "source"], "left_anti")
        products = crawl_products(usable)
        found = products.groupBy("request_id").agg(F.count("*").alias("product_count"))
        error = F.coalesce("render_error", "parse_error", "access_error")
        named = F.when(error.isNotNull(), F.struct("source_ord", F.concat_ws(": ", "source", error).alias("message")))
        seen = counters.groupBy("request_id").agg(
            F.count_if(F.coalesce("render_error", "parse_error").isNotNull()).alias("render_errors"), F.count_if(error.isNotNull()).alias("error_count"),
            F.transform(F.array_sort(F.collect_list(named)), lambda x: x["message"]).alias("errors"),
        )
        asked = requests.select("request_id", "query").distinct()
        status = asked.join(seen, "request_id", "left").join(found, "request_id", "left").fillna(0, ["render_errors", "error_count", "product_count"])
        kind = crawl_status(F.col("product_count"), F.col("render_errors"), F.col("error_count"))
        return products, counters, status.select("request_id", "query", "product_count", kind.alias("status"), F.when(kind.isin("render_error", "access_error"), F.col("errors")[0]).alias("error"), "errors")

    def candidate_counters(self, requests: DataFrame, pages: DataFrame) -> DataFrame:
        """How many candidates each page gave, how many products they became, and which have images."""
        raw = exploded(parse_pages(pages.join(F.broadcast(requests), "source")))
        reduced = aggregate_candidates(raw)
        return candidate_summary(raw, reduced, eligible(reduced))

    # -- collect ----------------------------------------------------------------------------------------

    def collect(self, name: str, query: str | None = None, limit: int = 50) -> dict:
        """Run a collector, store its products and log the run; a failed run is logged, then raised."""
        if name not in self.collectors:
            raise KeyError(f"unknown source: {name}")
        if not 1 <= limit <= 200:
            raise ValueError("limit is 1 to 200")
        collector, platform, *_ = self.collectors[name]
        started, count, failure = time.perf_counter(), 0, None
        failures: list = []
        try:
            products = collector(query, limit)
            if isinstance(products, tuple):
                products, failed = products
                failures = [(r["source_name"], r["error_message"]) for r in failed.orderBy("source_ord").collect()]
            count = self.store.add(products.withColumn("platform", F.lit(platform))).count()
            for source, message in failures:
                self.store.record(source, platform, "failed", error_message=message)
            status = "success" if not failures else "partial_success" if count else "failed"
            message = "; ".join(f"{s}: {m}" for s, m in failures) or None
        except Exception as error:
            failure, status, message, count = error, "failed", str(error), 0
        elapsed = round((time.perf_counter() - started) * 1000, 2)
        self.store.record(name, platform, status, count, elapsed, message)
        if status == "failed":
            raise RuntimeError(message) from failure
        return {"source_name": name, "status": status, "product_count": count, "response_time_ms": elapsed, "error_message": message}

    def benchmark(self, name: str, queries=("coffee", "laptop", "shirt"), limit: int = 20) -> DataFrame:
        """Quality of a collector's results by query, and of all queries together."""
        collector = self.collectors[name][0]
        found = None
        for q in queries:
            rows = collector(q, limit)
            rows = (rows[0] if isinstance(rows, tuple) else rows).withColumn("query", F.lit(q))
            for c in ("shipping_fee", "detail_description"):
                rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return benchmark_summary(found)

    # -- import -----------------------------------------------------------------------------------------

    def import_products(self, path: str, data_source: str, source_url: str | None = None, source_license: str | None = None, observed_at=None, limit: int = 20) -> int:
        if not 1 <= limit <= 10000:
            raise ValueError("limit is 1 to 10000")
        rows = as_products(file_rows(self.spark, path), data_source, source_url, source_license, observed_at, limit=limit)
        try:
            saved = self.store.add(rows.drop("ord")).count()
        except Exception as error:
            self.store.record(data_source, "shopping_mall", "failed", error_message=str(error))
            raise
        self.store.record(data_source, "shopping_mall", "success", saved)
        return saved

    def import_saved(self, path: str, data_source: str = "saved_html_import", source_url: str | None = None, observed_at=None, limit: int | None = None) -> dict:
        """Import once more without storing a link twice."""
        seen = observed_at or modified_at(self.spark, path)
        rows = as_products(file_rows(self.spark, path), data_source, source_url, None, seen, "naver_shopping", limit).persist()
        try:
            read, saved = rows.count(), self.store.add_new(rows, ("ord",)).count()
        finally:
            rows.unpersist()
        self.store.record(data_source, "naver_shopping", "success", saved)
        return {"read_count": read, "saved_count": saved, "skipped_count": read - saved, "source_observed_at": seen}

    # -- ask --------------------------------------------------------------------------------------------

    def products(self, **options) -> DataFrame:
        return self.store.list(**options)

    def search(self, query: str, limit: int = 50) -> DataFrame:
        return self.store.search(query, limit)

    def sources(self) -> DataFrame:
        rows = [(n, p, key, True, ready, i) for i, (n, (_, p, key, ready)) in enumerate(self.collectors.items())]
        schema = "source_name string, platform string, requires_api_key boolean, enabled boolean, configured boolean, position int"
        board = source_dashboard(self.spark.createDataFrame(rows, schema), self.store.sources())
        return board.orderBy(F.asc_nulls_last("position"), "source_name")

    def quality(self) -> DataFrame:
        return summarize_products(self.store.products)
