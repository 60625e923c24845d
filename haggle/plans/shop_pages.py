"""Result pages of shops, written from the rows of ``part``: what extraction queries and benchmarks read.

A page holds twenty parts.  Items are given as Spark SQL expressions over a part's columns; ``n`` is its
key, ``amount`` its price in won and ``won`` that price with separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.plans.views import read
from haggle.session import spread

PER_PAGE = 20
#: The same page and price of a part in DuckDB.
ITEMS_SQL = "items AS (SELECT *, p_partkey AS n, p_partkey // 20 AS page_id, 1000 + p_partkey * 10 AS amount, format('{:,}', 1000 + p_partkey * 10) AS won FROM part)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A dimension elsewhere; here every row becomes a text to parse.
    return spread(_items(spark, sf_dir))


def file_number(rows: int = 1000) -> Column:
    """The JSON file of an item: files of a page each would cost more to make and open than to read."""
    return F.floor(F.col("n") / rows)


def by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items dealt out by page in as many tasks as a shuffle has: pages are parsed or written where they are gathered, and
    their few bytes would else be coalesced into a few tasks."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _items(spark, sf_dir).repartition(tasks, "page_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("p_partkey") * 10 + 1000
    return read(spark, sf_dir, "part").select(
        "*", F.col("p_partkey").alias("n"), F.floor(F.col("p_partkey") / PER_PAGE).alias("page_id"), amount.alias("amount"), F.format_number(amount, 0).alias("won")
    )


def pages(spark: SparkSession, sf_dir: str, item: str, before: str = "", after: str = "", between: str = "") -> DataFrame:
    """``page_id, html``: the items of a page, in order, between the given texts."""
    # Twenty items at most make a page.
    grouped = by_page(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", F.expr(item).alias("item")))).alias("all"))
    return grouped.select("page_id", F.concat(F.lit(before), F.array_join(F.transform("all", lambda x: x["item"]), between), F.lit(after)).alias("html"))


def asked(pages: DataFrame, source: str | None | Column = None, limit: int = 20, hints: tuple[str, ...] = ()) -> DataFrame:
    """Pages with what a crawl knows of them."""
    return pages.select(
        "page_id", "html", (source if isinstance(source, Column) else F.lit(source).cast("string")).alias("source"), F.lit(None).cast("string").alias("query"), F.lit(limit).alias("limit"),
        F.array(*map(F.lit, hints)).cast("array<string>").alias("product_url_hints"),
    )
