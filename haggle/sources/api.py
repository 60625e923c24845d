"""Products from the saved answers of two marketplace APIs."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.functions.price import lenient_number, strict_number
from haggle.functions.text import marketplace_condition, present, shipping_from_field

MOST = 200
ITEM = (
    "struct<title:string,price:struct<value:string,currency:string>,shippingOptions:array<struct<shippingCost:struct<value:string>>>,seller:struct<username:string>,"
    "itemWebUrl:string,image:struct<imageUrl:string>,condition:string,categories:array<struct<categoryName:string>>,categoryPath:string,"
    "itemLocation:struct<city:string,stateOrProvince:string,country:string>>"
)


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("ord") < min(limit, MOST)).withColumn("ord", F.col("ord").cast("bigint"))


def ebay_products(answers: DataFrame, limit: int = 50) -> DataFrame:
    """Products of browse answers (column ``json`` with itemSummaries); at most 200 of an answer."""
    items = answers.select(F.from_json("json", f"struct<itemSummaries:array<{ITEM}>>").alias("j")).select(F.posexplode("j.itemSummaries").alias("ord", "i"))
    place = F.filter(F.array("i.itemLocation.city", "i.itemLocation.stateOrProvince", "i.itemLocation.country"), lambda p: p.isNotNull() & (p != ""))
    costs = F.transform("i.shippingOptions", lambda o: strict_number(o["shippingCost"]["value"]))
    return _numbered(items, limit).select(
        "ord",
        F.coalesce(present(F.col("i.title")), F.lit("Untitled eBay item")).alias("product_name"),
        strict_number(F.col("i.price.value")).alias("price"),
        F.try_element_at(F.filter(costs, lambda c: c.isNotNull()), F.lit(1)).alias("shipping_fee"),
        F.coalesce(present(F.col("i.price.currency")), F.lit("USD")).alias("currency"),
        F.when(F.size("i.categories") > 0, F.try_element_at("i.categories", F.lit(-1))["categoryName"]).otherwise(F.col("i.categoryPath")).alias("category"),
        F.coalesce(present(F.col("i.seller.username")), F.lit("eBay seller")).alias("seller"),
        F.lit("shopping_mall").alias("platform"),
        F.col("i.itemWebUrl").alias("product_url"),
        F.col("i.image.imageUrl").alias("image_url"),
        F.coalesce(marketplace_condition(F.col("i.condition")), F.lit("unknown")).alias("condition"),
        present(F.array_join(place, ", ")).alias("region"),
        F.lit("ebay_browse").alias("data_source"),
    )


#: The tags of a product node that are read.
TAGS = ("ProductName", "ProductPrice", "SalePrice", "Delivery", "ShipFee", "Seller", "ProductDetailUrl", "DetailPageUrl", "ImageUrl", "ProductImage", "BasicImage")


def node_texts(xml: str) -> dict[str, str]:
    """The text of the first child of each name in a node, that of its own children included; not well-formed is an error."""
    said: dict[str, list[str]] = {}
    depth, into = 0, None

    def opened(name, _):
        nonlocal depth, into
        depth += 1
        if depth == 2:
            into = None if name in said else said.setdefault(name, [])

    def closed(_):
        nonlocal depth, into
        depth -= 1
        if depth == 1:
            into = None

    def text(part):
        if into is not None:
            into.append(part)

    parser = expat.ParserCreate()  # without a separator names keep their prefixes, as the node has lost their declarations
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, text
    parser.Parse(xml, True)
    return {name: "".join(parts) for name, parts in said.items()}


def _tags(node: pa.Array) -> pa.Array:
    """Each node is parsed once, whatever the number of its tags."""
    rows = [node_texts(n) if n is not None else {} for n in node.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r.get(t) for r in rows], pa.string()) for t in TAGS], list(TAGS))


def elevenst_products(answers: DataFrame, limit: int = 50) -> DataFrame:
    """Products of XML answers (column ``xml``); an answer with an error node raises it."""
    said = lambda *tags: F.coalesce(*(present(F.trim(F.xpath_string("xml", F.lit(f"//Error/{t}")))) for t in tags))
    message = F.concat(F.lit("API error "), F.coalesce(said("Code", "code"), F.lit("unknown")), F.lit(": "), F.coalesce(said("Message", "message"), F.col("xml")))
    failed = F.xpath_boolean("xml", F.lit("//Error"))
    checked = answers.withColumn("xml", F.when(failed, F.raise_error(message)).otherwise(F.col("xml")))
    parts = checked.select(F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<Product(?:\s[^>]*)?>(.*?)</Product>"), F.lit(1))).alias("ord", "node"))
    node = F.concat(F.lit("<Product>"), "node", F.lit("</Product>"))
    tags = F.arrow_udf(_tags, "struct<" + ", ".join(f"{t} string" for t in TAGS) + ">")
    parts = _numbered(parts, limit).withColumn("said", tags(node))
    tag = lambda *names: F.coalesce(*(present(F.trim(F.col("said")[n])) for n in names))
    return parts.select(
        "ord",
        F.coalesce(tag("ProductName"), F.lit("Untitled 11st product")).alias("product_name"),
        lenient_number(tag("ProductPrice", "SalePrice")).alias("price"),
        shipping_from_field(tag("Delivery", "ShipFee"), english=False).alias("shipping_fee"),
        F.lit("KRW").alias("currency"),
        F.lit(None).cast("string").alias("category"),
        F.coalesce(tag("Seller"), F.lit("11st seller")).alias("seller"),
        F.lit("shopping_mall").alias("platform"),
        tag("ProductDetailUrl", "DetailPageUrl").alias("product_url"),
        tag("ImageUrl", "ProductImage", "BasicImage").alias("image_url"),
        F.lit("new").alias("condition"),
        F.lit(None).cast("string").alias("region"),
        F.lit("elevenst").alias("data_source"),
    )


def fixture_products(spark: SparkSession, path: str, query: str | None = None, limit: int = 50) -> DataFrame:
    """Products of a JSON fixture whose name, category or seller has the query, in any case."""
    rows = spark.read.json(path, multiLine=True)
    if query:
        low = query.lower()
        hit = F.lit(False)
        for c in ("product_name", "category", "seller"):
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False))
        rows = rows.where(hit)
    return rows.limit(limit)
