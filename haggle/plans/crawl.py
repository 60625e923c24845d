"""The crawl: pages to candidates, to products, to results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.functions.price import parse_price
from haggle.functions.text import squash
from haggle.functions.urls import absolute_url
from haggle.operators.filters import eligible, valid_products
from haggle.operators.reduce import aggregate_candidates, keep_first, top_n


def normalize(candidates: DataFrame, absolute: bool = False) -> DataFrame:
    """Candidates as products: blank texts null, defaults filled in, links resolved; unnamed ones go."""
    condition = F.coalesce(squash(F.col("condition")), F.col("default_condition"))
    return candidates.select(
        "request_id",
        squash(F.col("product_name")).alias("product_name"),
        F.coalesce("price", parse_price(F.col("price_text"))).alias("price"),
        F.coalesce(squash(F.col("currency")), F.lit("KRW")).alias("currency"),
        "source",
        squash(F.col("seller")).alias("seller"),
        F.when((condition == "unknown") & F.col("used_only"), "used").otherwise(condition).alias("condition"),
        F.col("country"),
        absolute_url(F.col("product_url"), F.col("page_url"), absolute).alias("product_url"),
        absolute_url(F.col("image_url"), F.col("page_url"), absolute).alias("image_url"),
        squash(F.col("description")).alias("description"),
        "source_ord",
        "confidence",
        "ord",
        "max_price",
        "limit",
    ).where("product_name is not null")


def dedupe_products(products: DataFrame) -> DataFrame:
    """The first product of each source, link (or lower-case name) and price."""
    linked = F.nullif("product_url", F.lit("")).isNotNull()
    # The key stands for the link while rows are dealt out; of a row without one it is remembered how it was said.
    keyed = products.withColumns({"_blank": F.when(~linked, F.coalesce(F.col("product_url"), F.lit("-"))), "product_url": F.when(linked, F.col("product_url")).otherwise(F.lower("product_name"))})
    first = keep_first(keyed, ["request_id", "source", "product_url", "price"], [F.asc("source_ord"), F.desc("confidence"), F.asc("ord")])
    return first.withColumn("product_url", F.when(F.col("_blank").isNull(), F.col("product_url")).otherwise(F.nullif("_blank", F.lit("-")))).drop("_blank")


def crawl_products(candidates: DataFrame, absolute: bool = False, cap: bool = True) -> DataFrame:
    """Products of each request in result order: sources as registered, then by confidence.

    ``candidates`` carry their request, page and source rules (see ``CARRIED``) and their place ``ord``
    in the page, from 0; a source has one page in a request.  With ``cap`` each page brings at most eight
    times the limit, in extraction order, as a crawl does."""
    if cap:
        candidates = candidates.where(F.col("ord") < F.col("limit") * 8)
    reduced = aggregate_candidates(candidates, absolute)
    valid = valid_products(normalize(eligible(reduced), absolute), F.col("max_price"))
    unique = dedupe_products(valid)
    return top_n(unique, ["request_id"], ["source_ord", F.desc("confidence"), "ord", "product_url"], F.col("limit"), "rank")
