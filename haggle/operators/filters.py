"""Filters of candidates and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.text import BAD_NAMES, squash
from haggle.functions.urls import valid_http

PLATFORMS = ("shopping_mall", "naver_shopping", "secondhand", "group_buy", "youtube_shopping", "test")
CONDITIONS = ("new", "used", "refurbished", "unknown")


def url_allowed(url: Column) -> Column:
    """No excluded hint, no advertising hint unless allowed, all canonical hints (or any http(s) link)."""
    low = F.lower(url)
    has = lambda hints: F.exists(hints, lambda h: F.contains(low, F.lower(h)))
    canonical = F.col("canonical_product_url_hints")
    return (
        ~has(F.col("excluded_url_hints"))
        & (F.col("allow_ad_products") | ~has(F.col("ad_url_hints")))
        & F.when(F.size(canonical) > 0, F.forall(canonical, lambda h: F.contains(low, F.lower(h)))).otherwise(url.rlike(r"\A(?i:https?)://[^/?#]+"))
    )


def eligible(candidates: DataFrame) -> DataFrame:
    """Products worth showing: a good name, an allowed link with an identity, a price if one is required."""
    name = squash(F.col("product_name"))
    return candidates.where(
        name.isNotNull()
        & ~F.lower(name).isin(*BAD_NAMES)
        & F.col("url").isNotNull()
        & F.col("identity").isNotNull()
        & url_allowed(F.col("url"))
        & (~F.col("require_positive_price") | (F.coalesce("price", F.lit(0)) > 0))
    )


def valid_products(products: DataFrame, max_price: Column | None = None) -> DataFrame:
    """Named products with a price of 0 or more and at most ``max_price``, and valid links; a null
    price or link passes."""
    price = F.col("price")
    ok = (F.trim("product_name") != "") & (price.isNull() | (price >= 0)) & valid_http(F.col("product_url")) & valid_http(F.col("image_url"))
    if max_price is not None:
        ok = ok & (max_price.isNull() | price.isNull() | (price <= max_price))
    return products.where(ok)


def access_error(title: Column, status: Column, length: Column, links: Column) -> Column:
    """Why a page is no result page, or null."""
    low = F.lower(F.coalesce(title, F.lit("")))
    marks = ("the request could not be satisfied", "access denied", "forbidden", "error")
    named = F.lit(False)
    for m in marks:
        named = named | low.contains(m)
    return F.when(status >= 400, F.concat(F.lit("Source returned HTTP status "), status.cast("string"))).when(
        named & (length < 5000) & (links == 0), "Source returned an error page"
    )


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(products: DataFrame, query: str, columns=("product_name", "category", "seller", "data_source")) -> DataFrame:
    """Rows where a column has the text, A-Z and a-z alike; ``%`` and ``_`` are wildcards and a
    backslash is a character like any other."""
    pattern = ascii_lower(F.lit("%" + query.replace("\\", "\\\\") + "%"))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.like(ascii_lower(F.col(c)), pattern), F.lit(False))
    return products.where(hit)


def violations(products: DataFrame) -> DataFrame:
    """Rows that break the product model, with the first rule broken."""
    bad = (
        F.when(F.coalesce(F.length("product_name"), F.lit(0)) < 1, "product_name")
        .when((F.col("price") < 0) | (F.col("original_price") < 0) | (F.col("shipping_fee") < 0), "negative amount")
        .when(F.coalesce(F.length("currency"), F.lit(0)) != 3, "currency")
        .when(~F.coalesce(F.col("platform").isin(*PLATFORMS), F.lit(False)), "platform")
        .when(~F.coalesce(F.col("condition").isin(*CONDITIONS), F.lit(False)), "condition")
        .when(~valid_http(F.col("product_url")) | ~valid_http(F.col("image_url")), "url")
        .when(F.coalesce(F.length("data_source"), F.lit(0)) < 1, "data_source")
    )
    return products.withColumn("violation", bad).where("violation is not null")
