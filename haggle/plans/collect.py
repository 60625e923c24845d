"""Collections from fetched list pages: several sources at once, or the pages of one search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from haggle.extract.frames import list_products
from haggle.functions.urls import identity_key, tidy_url
from haggle.operators.reduce import keep_first
from haggle.operators.summary import missing_counts
from haggle.session import shared_folder
from haggle.sources.config import SiteConfig, configs_frame, configured_pages
from haggle.sources.registry import page_urls

MOST = 20
UNKNOWN_SITE = "no configuration for this host"


def robots_allow(robots: str | None, url: str, agent: str) -> bool:
    """Whether a site's robots.txt lets the agent fetch the address; without one everything is allowed."""
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse((robots or "").splitlines())
    return parser.can_fetch(agent, url)


def gate(pages: DataFrame, agent: str = "haggle/1.0") -> DataFrame:
    """Adds ``page_error``: a fetch error that the page already has, or a robots.txt that forbids it.

    ``pages`` have url, html, and may have robots_txt and fetch_error."""
    columns = pages.columns
    error = F.col("fetch_error") if "fetch_error" in columns else F.lit(None).cast("string")
    if "robots_txt" in columns:
        @F.pandas_udf(BooleanType())
        def allowed(robots: pd.Series, url: pd.Series) -> pd.Series:
            return pd.Series([robots_allow(r, u, agent) for r, u in zip(robots, url)])

        blocked = F.when(~allowed(F.col("robots_txt"), F.col("url")), F.concat(F.lit("robots.txt does not allow fetching "), F.col("url")))
        error = F.coalesce(error, blocked)
    return pages.withColumn("page_error", error)


def _products(parsed: DataFrame, carried: list[str]) -> DataFrame:
    return parsed.select(*carried, F.posexplode("products").alias("card_ord", "p")).select(*carried, F.col("card_ord").cast("bigint").alias("card_ord"), "p.*")


def list_collection(pages: DataFrame, configs: list[SiteConfig], limit: int = MOST) -> DataFrame:
    """Products of approved list pages, each link once, at most twenty; an unknown host is an error.

    ``pages``: page_ord, url, html."""
    spark = pages.sparkSession
    known = configured_pages(gate(pages), configs_frame(spark, configs))
    bad = F.coalesce("page_error", F.when(F.col("config_ord").isNull(), F.lit(UNKNOWN_SITE)))
    checked = known.withColumn("html", F.when(bad.isNotNull(), F.raise_error(F.concat_ws(": ", "url", bad))).otherwise(F.col("html")))
    rows = _products(list_products(checked, limit), ["page_ord", "url"])
    unique = keep_first(rows, ["product_url"], ["page_ord", "card_ord"])
    return unique.orderBy("page_ord", "card_ord").limit(min(limit, MOST)).withColumn("data_source", F.lit("approved_html"))


def collect_sources(spark: SparkSession, pages: DataFrame, configs: list[SiteConfig], api: dict[str, DataFrame] | None = None, limit: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Products of all approved sources in their order, each link once; and the sources that failed.

    ``pages``: source_name, page_ord, url, html (and robots_txt, fetch_error).  A source of which a
    page fails gives no products but a row with the error; API sources bring ready products."""
    most = min(limit, MOST)
    approved = [(i, c) for i, c in enumerate(configs) if c.approved]
    table = spark.createDataFrame(
        [(i, c.name, c.selectors, c.attributes, c.default_seller) for i, c in approved if c.collection_method == "approved_html"],
        "source_ord int, source_name string, selectors map<string,string>, attributes map<string,string>, default_seller string",
    )
    parsed = list_products(gate(pages).join(F.broadcast(table), "source_name"), most)
    error = F.coalesce("page_error", "parse_error")
    failed = parsed.where(error.isNotNull()).groupBy("source_ord", "source_name").agg(F.min_by(error, "page_ord").alias("error_message"))
    products = _products(parsed.join(failed.select("source_name"), "source_name", "left_anti"), ["source_ord", "source_name", "page_ord", "url", "default_seller"])
    # A source stops at the page that fills its limit.
    so_far = F.count("*").over(Window.partitionBy("source_name").orderBy("page_ord").rangeBetween(Window.unboundedPreceding, -1))
    products = products.withColumn("_before", so_far).where(F.col("_before") < most).drop("_before")
    shaped = products.select(
        "source_ord", "page_ord", "card_ord", "product_name", "price", "shipping_fee", F.coalesce("seller", "default_seller").alias("seller"), "detail_description",
        "product_url", "image_url", F.lit("KRW").alias("currency"), F.lit("new").alias("condition"), F.col("url").alias("source_url"), F.col("source_name").alias("data_source"),
    )
    missing = []
    for i, c in approved:
        if c.collection_method == "api":
            ready = (api or {}).get(c.api_collector or "")
            if ready is None:
                missing.append((i, c.name, f"API collector is not registered: {c.api_collector}"))
                continue
            rows = ready.where("product_url is not null").limit(most).withColumn("seller", F.coalesce("seller", F.lit(c.default_seller)))
            rows = rows.select(F.lit(i).alias("source_ord"), F.lit(0).alias("page_ord"), F.col("ord").alias("card_ord"), *(k for k in rows.columns if k not in ("ord", "data_source")), F.lit(c.name).alias("data_source"))
            shaped = shaped.unionByName(rows, allowMissingColumns=True)
    failed = failed.union(spark.createDataFrame(missing, "source_ord int, source_name string, error_message string"))
    unique = keep_first(shaped, ["product_url"], ["source_ord", "page_ord", "card_ord"])
    return unique.orderBy("source_ord", "page_ord", "card_ord").limit(most), failed


def paged_addresses(spark: SparkSession, source: SiteConfig, query: str, max_pages: int) -> DataFrame:
    """The addresses of a search's pages: page, url."""
    if not query or max_pages < 1:
        raise ValueError("a query and at least one page are needed")
    one = spark.createDataFrame([(source.search_url_template, query, source.page_start, source.page_param_step)], "template string, query string, page_start int, page_step int")
    return page_urls(one, max_pages).select("page", "url")


def row_identity(source_file: Column | None = None) -> Column:
    """The identity key of product rows with product_url, seller and product_name."""
    row = {c: F.col(c) for c in ("product_url", "seller", "product_name")} | {"source_file": F.lit(None).cast("string") if source_file is None else source_file}
    return identity_key(row, F.to_json(F.struct(*row.values())))


def collect_paged(pages: DataFrame, source: SiteConfig, query: str, per_page: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products of a search's pages, each product once; a row for each page; a row for the run.

    ``pages``: page, url, html (and robots_txt, fetch_error).  A failed page gives no products.  Pages are parsed once,
    into the shared folder; a product that stands on many pages is sent on once by each task."""
    spark = pages.sparkSession
    table = configs_frame(spark, [source]).select("selectors", "attributes", "default_seller")
    gated = gate(pages).crossJoin(F.broadcast(table))  # one row: the source's configuration
    parsed = list_products(gated.withColumn("html", F.when(F.col("page_error").isNull(), F.col("html")).otherwise("")), per_page)
    folder = shared_folder(spark, "paged")
    parsed.select("page", "url", F.coalesce("page_error", "parse_error").alias("error_message"), "products").write.parquet(folder)
    parsed = spark.read.parquet(folder)
    rows = _products(parsed.where("error_message is null"), ["page", "url"]).withColumn("dedupe_key", row_identity())
    products = keep_first(rows, ["dedupe_key"], ["page", "card_ord"]).select(
        "product_name", "price", "shipping_fee", "seller", "product_url", "image_url", F.col("url").alias("source_url"), F.lit(query).alias("source_query"),
        F.col("page").alias("source_page"), F.lit(source.name).alias("source_name"), F.lit(f"auto_html:{source.name}").alias("data_source"),
        tidy_url(F.col("product_url")).alias("normalized_product_url"), "dedupe_key", "card_ord",
    )
    extracted = F.when(F.col("error_message").isNull(), F.greatest(F.size("products"), F.lit(0))).alias("extracted")
    added = products.groupBy(F.col("source_page").alias("page")).agg(F.count("*").alias("added"))
    by_page = parsed.select("page", "url", "error_message", extracted).join(added, "page", "left").select(
        "page", "url", F.when(F.col("error_message").isNull(), "success").otherwise("failed").alias("status"),
        F.coalesce("extracted", F.lit(0)).cast("bigint").alias("extracted_count"), F.coalesce("added", F.lit(0)).cast("bigint").alias("unique_added_count"),
        (F.coalesce("extracted", F.lit(0)) - F.coalesce("added", F.lit(0))).cast("bigint").alias("duplicate_count"), "error_message",
    )
    totals = by_page.agg(
        F.count("*").alias("requested_pages"), F.count_if(F.col("status") == "success").alias("successful_pages"), F.sum("extracted_count").alias("total_extracted_count"),
        F.sum("duplicate_count").alias("duplicate_count"), F.sum("unique_added_count").alias("final_product_count"),
    )
    overall = totals.crossJoin(products.agg(*missing_counts()))  # one row each
    return products, by_page, overall.withColumn("source_name", F.lit(source.name)).withColumn("query", F.lit(query))
