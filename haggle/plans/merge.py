"""Saved result pages to one deduplicated product list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haggle.extract.frames import saved_products
from haggle.extract.saved import DEFAULT_URL
from haggle.functions.urls import query_value
from haggle.operators.summary import file_summary, missing_counts
from haggle.plans.collect import row_identity


def saved_rows(pages: DataFrame, source_url: str = DEFAULT_URL) -> tuple[DataFrame, DataFrame]:
    """Product rows of saved pages (path, html), and a summary for each page before any merge."""
    parsed = saved_products(pages.withColumn("source_url", F.lit(source_url))).drop("source_url")
    rows = parsed.select(F.col("path").alias("source_file"), F.posexplode("products").alias("item_ord", "p")).select("source_file", F.col("item_ord").cast("bigint").alias("item_ord"), "p.*")
    rows = rows.withColumn("source_query", query_value(F.col("source_url"), "query"))
    count = lambda kind: F.size(F.filter("products", lambda p: p["product_type"] == kind))
    summary = parsed.select(
        F.col("path").alias("source_file"), F.col("raw_count").alias("total_before_dedup"), F.size("products").alias("total_after_dedup"),
        count("ad").alias("ad_count"), count("organic").alias("organic_count"), (F.col("raw_count") - F.size("products")).alias("duplicate_count"),
    )
    return rows, summary


def merge_pages(pages: DataFrame, source_url: str = DEFAULT_URL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first row of each product over all files in path order; a summary by file; one of all."""
    rows, _ = saved_rows(pages, source_url)
    keyed = rows.withColumn("dedupe_key", row_identity(F.col("source_file")))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("source_file", "item_ord")))
    products = ranked.where("_rank = 1").drop("_rank")
    files = pages.select(F.col("path").alias("source_file")).join(file_summary(rows), "source_file", "left")
    files = files.fillna(0, [c for c in files.columns if c.endswith("count") or c.startswith("missing")])
    overall = ranked.agg(
        F.count("*").alias("total_extracted_count"), F.count_if(F.col("_rank") > 1).alias("duplicate_count"), F.count_if(F.col("_rank") == 1).alias("final_product_count"),
    ).crossJoin(  # one row each
        products.agg(F.count_if(F.col("product_type") == "ad").alias("ad_count"), F.count_if(F.col("product_type") == "organic").alias("organic_count"), *missing_counts())
    ).crossJoin(pages.agg(F.count("*").alias("file_count")))
    return products, files, overall

