"""Product files: CSV and JSON of any of the known column names, and saved pages in folders."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.functions.price import lenient_number
from haggle.session import shared_folder
from haggle.sources.csv_split import csv_rows
from haggle.sources.json_split import list_elements

# The names under which a field may stand in a file, in order.
ALIASES = {
    "product_name": ("product_name", "name", "title", "상품명", "물품식별명", "세부품명"),
    "price": ("price", "product_price", "sale_price", "가격", "판매가", "납품단가", "계약단가"),
    "original_price": ("original_price", "list_price", "regular_price", "normal_price", "정상가", "할인 전 가격"),
    "shipping_fee": ("shipping_fee", "delivery_fee", "배송비"),
    "seller": ("seller", "vendor", "provider", "판매처", "판매자", "업체", "공급업체"),
    "detail_description": ("detail_description", "description", "desc", "설명", "상품설명", "세부품명(명칭)"),
    "product_url": ("product_url", "url", "link", "상품URL", "상품 URL"),
    "image_url": ("image_url", "image", "상품이미지", "이미지URL"),
    "category": ("category", "카테고리", "물품분류명"),
    "source_url": ("source_url", "source", "original_search_url", "원본URL", "원본 URL"),
}
LIST_KEYS = ("items", "data", "products", "rows")
NUMBERS = ("price", "original_price", "shipping_fee")
PAGE_FILES = "*.{[hH][tT][mM],[hH][tT][mM][lL]}"
#: A scan puts few small files into a partition, since opening one counts as some MB.  From this many partitions for each
#: core on, one task reads up to so many of them.
PARTS_OF_CORE, PARTS_OF_TASK = 32, 64


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """``fields map<string,string>, ord``: rows of a JSON list, or of the first list under items, data, products or rows."""
    return list_elements(spark, path, LIST_KEYS).select(F.from_json("element", "map<string,string>").alias("fields"), "ord")


def fetched(spark: SparkSession, address: str) -> str:
    """A file behind an http(s) address, put into the shared folder; an import file is one document."""
    from urllib.request import urlopen

    with urlopen(address, timeout=30) as answer:
        text = answer.read().decode("utf-8-sig")
    folder = shared_folder(spark, "fetched")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    return folder


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .csv or .json file or address."""
    suffix = os.path.splitext(urlsplit(path).path)[1].lower()
    if path.startswith(("http://", "https://")):
        path = fetched(spark, path)
    if suffix == ".csv":
        return csv_rows(spark, path)
    if suffix == ".json":
        return json_rows(spark, path)
    raise ValueError(f"unsupported import file type: {suffix}")


def field(name: str) -> Column:
    """The first of a field's names that holds anything, trimmed."""
    return F.trim(F.coalesce(*(F.nullif(F.try_element_at("fields", F.lit(a)), F.lit("")) for a in ALIASES[name])))


def as_products(rows: DataFrame, data_source: str, source_url: str | None = None, source_license: str | None = None, observed_at=None, platform: str = "shopping_mall", limit: int | None = None) -> DataFrame:
    """File rows as products; rows without a name go, and the limit counts those that stay."""
    values = {n: lenient_number(field(n)) if n in NUMBERS else field(n) for n in ALIASES}
    made = rows.select(
        "ord",
        *(v.alias(n) for n, v in values.items() if n != "source_url"),
        F.coalesce(F.lit(source_url), values["source_url"]).alias("source_url"),
        F.lit("KRW").alias("currency"),
        F.lit(platform).alias("platform"),
        F.lit("unknown").alias("condition"),
        F.lit(source_license).cast("string").alias("source_license"),
        F.lit(observed_at).cast("timestamp").alias("source_observed_at"),
        F.lit(data_source).alias("data_source"),
    ).where("product_name <> ''")
    return made.orderBy("ord").limit(limit) if limit else made


def modified_at(spark: SparkSession, path: str):
    """When a file was last changed: the observation time of saved results."""
    return spark.read.format("binaryFile").load(path).select(F.max("modificationTime")).first()[0]


def html_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, html`` of the .html and .htm files in files and folders, each file once; ``path`` is their order.

    A missing path is an error; a file of another kind is passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PAGE_FILES).load(list(paths))
    # One listing: files of folders that overlap are one set to Spark when it looks into folders.
    pages = found.select("path", F.decode("content", "UTF-8").alias("html"))
    parts, least = found.rdd.getNumPartitions(), PARTS_OF_CORE * spark.sparkContext.defaultParallelism
    return pages.coalesce(max(least, parts // PARTS_OF_TASK)) if parts > least else pages
