"""Counts and summaries of products, pages, files and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = ("product_name", "price", "shipping_fee", "seller", "product_url", "image_url")


def latest_run(runs: DataFrame) -> DataFrame:
    """Each source's last run by start, then id; one row for each source and task is exchanged."""
    last = F.max_by(F.struct("status", "response_time_ms", "error_message"), F.struct("started_at", "id"))
    return runs.groupBy("source_name").agg(last.alias("run")).select(
        F.col("source_name").alias("data_source"),
        F.col("run.status").alias("last_status"),
        F.col("run.response_time_ms").alias("last_response_time_ms"),
        F.col("run.error_message").alias("last_error_message"),
    )


def source_summary(products: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored products by source with the source's last run; sources without products have no row."""
    counted = products.groupBy("data_source").agg(F.count("*").alias("product_count"), F.max("collected_at").alias("last_collected_at"))
    return counted.join(latest_run(runs), "data_source", "left")


def source_dashboard(registered: DataFrame, summary: DataFrame) -> DataFrame:
    """Registered collectors with what is stored of them, then stored sources nobody registered.

    ``registered``: source_name, platform, requires_api_key, enabled, configured, position."""
    both = registered.join(summary.withColumnRenamed("data_source", "source_name"), "source_name", "full_outer")
    default = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return both.select(
        "source_name",
        default("platform", "shopping_mall"),
        default("requires_api_key", False),
        default("enabled", True),
        default("configured", True),
        F.coalesce("configured", F.lit(True)).alias("connected"),
        F.coalesce("product_count", F.lit(0)).cast("bigint").alias("product_count"),
        "last_collected_at",
        "last_status",
        "last_response_time_ms",
        "last_error_message",
        "position",
    )


def _rate(c: str) -> Column:
    return F.bround(F.avg(F.col(c).isNull().cast("double")), 4)


def quality_aggregates() -> list[Column]:
    """Product and seller counts and the shares of missing fields."""
    return [
        F.count("*").alias("product_count"),
        F.count_distinct(F.nullif("seller", F.lit(""))).alias("seller_count"),
        F.coalesce(_rate("price"), F.lit(0.0)).alias("missing_price_rate"),
        F.coalesce(_rate("shipping_fee"), F.lit(0.0)).alias("missing_shipping_fee_rate"),
        F.coalesce(_rate("product_url"), F.lit(0.0)).alias("missing_product_url_rate"),
        # Without products this rate is absent.
        _rate("detail_description").alias("missing_detail_description_rate"),
    ]


def summarize_products(products: DataFrame, by: list[str] | None = None) -> DataFrame:
    return products.groupBy(*(by or [])).agg(*quality_aggregates())


def missing_counts(columns=MISSING) -> list[Column]:
    return [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing_{c}") for c in columns]


def benchmark_summary(products: DataFrame, by: str = "query") -> DataFrame:
    """One row for each query and one (null query) for all; sellers of all queries count once.

    Products are read once, for both kinds of rows; without any, there is the row for all alone."""
    sets = products.groupingSets([[by], []], by).agg(*quality_aggregates(), F.grouping_id().alias("_all"))
    # Grouping sets give no row for all where there is nothing to group.
    nothing = products.limit(0).agg(*quality_aggregates()).withColumns({by: F.lit(None).cast(products.schema[by].dataType), "_all": F.lit(1).cast("bigint")})
    found = sets.withColumn("_place", F.lit(0)).unionByName(nothing.withColumn("_place", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(by, "_all").orderBy("_place"))
    return found.withColumn("_first", first).where("_first = 1").drop("_all", "_place", "_first")


def file_summary(rows: DataFrame) -> DataFrame:
    """Extracted rows by file: advertised, organic, missing fields."""
    return rows.groupBy("source_file").agg(
        F.count("*").alias("extracted_count"),
        F.count_if(F.col("product_type") == "ad").alias("ad_count"),
        F.count_if(F.col("product_type") != "ad").alias("organic_count"),
        *missing_counts(),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """By source: success, partial_success or failed, from its runs, and the failures joined."""
    failed = F.col("status") == "failed"
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("id", F.concat_ws(": ", "source_name", "error_message").alias("m"))))), lambda x: x["m"]), "; ")
    grouped = runs.groupBy("source_name").agg(
        F.count_if(failed).alias("failed_count"), F.sum("product_count").alias("product_count"), F.nullif(listed, F.lit("")).alias("error_message")
    )
    status = F.when((F.col("failed_count") > 0) & (F.col("product_count") > 0), "partial_success").when(F.col("failed_count") > 0, "failed").otherwise("success")
    return grouped.withColumn("status", status)


def crawl_status(products: Column, render_errors: Column, errors: Column) -> Column:
    return F.when(products > 0, "success").when(render_errors > 0, "render_error").when(errors > 0, "access_error").otherwise("no_results")


def selector_ranking(found: DataFrame, top: int = 8) -> DataFrame:
    """Field selectors by the cards they match, then matches, then first seen.

    ``found``: page_id, field, selector, card, ord, value; a null value only marks a matched card."""
    grouped = found.groupBy("page_id", "field", "selector").agg(
        F.count("value").alias("match_count"), F.count_distinct("card").alias("matching_cards"), F.min("ord").alias("ord"),
        F.slice(
            F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ord", "value")))), lambda x: x["value"])), 1, 3
        ).alias("sample_values"),
    )
    rank = F.row_number().over(Window.partitionBy("page_id", "field").orderBy(F.desc("matching_cards"), F.desc("match_count"), "ord"))
    return grouped.withColumn("rank", rank).where(F.col("rank") <= top).drop("ord")


def secondhand_summary(rows: DataFrame) -> DataFrame:
    """By saved file: second-hand products and what they lack; result pages never show a region."""
    lacks = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == ""))
    return rows.groupBy(F.col("path").alias("source_file")).agg(
        F.count("*").alias("product_count"), lacks("product_name").alias("missing_name"), lacks("price").alias("missing_price"), lacks("image_url").alias("missing_image"),
        F.count("*").alias("missing_region"), lacks("sale_status").alias("missing_sale_status"),
    )


def candidate_summary(raw: DataFrame, reduced: DataFrame, kept: DataFrame) -> DataFrame:
    """By request and source: candidates as found, as reduced and as kept, those with images, and
    up to five examples of images with an identity."""
    by = ["request_id", "source"]
    pictured = F.col("image_url").isNotNull() & (F.col("image_url") != "")
    named = pictured & F.col("identity").isNotNull()
    example = F.when(named, F.struct("ord", "identity", "image_url", "product_url"))
    found = raw.groupBy(*by).agg(F.count("*").alias("raw_candidate_count"), F.count_if(pictured).alias("raw_image_candidate_count"))
    grouped = reduced.groupBy(*by).agg(
        F.count("*").alias("aggregated_candidate_count"), F.count_if(named).alias("image_candidates_with_identity_count"),
        # A page's products are capped, so its examples fit in a row before they are cut to five.
        F.slice(F.array_sort(F.collect_list(example)), 1, 5).alias("image_examples"),
    )
    last = kept.groupBy(*by).agg(F.count("*").alias("normalized_candidate_count"), F.count_if(pictured).alias("aggregated_image_candidate_count"))
    return found.join(grouped, by, "left").join(last, by, "left").fillna(0)
