"""The extractors on DataFrames of pages: one parse for each page, rows in, rows out.

Pages are few and large, so they go through Arrow in small batches; HTML is dropped right after
the parse, before anything is exchanged.  A null page is an empty one; a page on which an
extractor fails gives a row with its error, not a failed job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

CANDIDATE = (
    "product_name string, price bigint, price_text string, seller string, condition string, product_url string, image_url string, description string, "
    "currency string, confidence double, raw string"
)
STATS = (
    "html_length bigint, json_ld_script_count bigint, embedded_json_candidate_count bigint, total_link_count bigint, product_like_link_count bigint, "
    "dom_candidate_count bigint, script_count bigint"
)


#: Pages whose rows a task holds together: those of a whole Arrow batch of short pages are many times its bytes.
TOGETHER = 128


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER))


def map_pages(pages: DataFrame, inputs: list[str], read: Callable[..., dict], schema: str) -> DataFrame:
    """Adds the columns of ``schema`` (and ``parse_error``) that ``read`` makes of the inputs; html is dropped."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    others = [c for c in pages.columns if c != "html" and c not in [f.name for f in _parse_datatype_string(schema)]]
    made = StructType([*_parse_datatype_string(schema).fields, *_parse_datatype_string("parse_error string").fields])
    kind = StructType([*(StructField(c, pages.schema[c].dataType) for c in others), *made.fields])
    arrow = to_arrow_schema(made)

    def run(batches):
        for batch in in_parts(batches):
            columns = [batch.column(len(others) + i).to_pylist() for i in range(len(inputs))]
            rows = []
            for values in zip(*columns):
                try:
                    rows.append(read(*values) | {"parse_error": None})
                except Exception as error:  # one page's failure is that page's row
                    rows.append({"parse_error": f"{type(error).__name__}: {error}"})
            arrays = [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *arrays], [*others, *arrow.names])

    return pages.select(*others, *(F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs))).mapInArrow(run, kind)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Candidates (an array in extraction order) and counters of result pages.

    ``pages``: html, source, query, limit, product_url_hints and whatever else."""
    from .generic import extract

    def read(html, source, hints, query, limit):
        found, stats = extract(html or "", source, tuple(hints or ()), query, limit or 160)
        return {"candidates": found, "stats": stats}

    capped = pages.withColumn("_cap", F.col("limit") * 8)
    schema = f"candidates array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>, stats struct<{STATS.replace(' ', ':').replace(',:', ',')}>"
    return map_pages(capped, ["html", "source", "product_url_hints", "query", "_cap"], read, schema).drop("_cap")


def exploded(parsed: DataFrame) -> DataFrame:
    """One row for each candidate, with its ordinal."""
    carried = [c for c in parsed.columns if c not in ("candidates", "stats", "parse_error", "title", "country")]
    return parsed.select(*carried, F.col("country").alias("_country") if "country" in parsed.columns else F.lit("KR").alias("_country"), F.posexplode("candidates").alias("ord", "c")).select(
        *carried, F.col("_country").alias("country"), F.col("ord").cast("bigint").alias("ord"), "c.*"
    )


def page_scripts(pages: DataFrame) -> DataFrame:
    """One row for each script: type, id, content."""
    from .generic import events, scripts

    found = map_pages(pages, ["html"], lambda h: {"scripts": scripts(events(h or ""))}, "scripts array<struct<type:string,id:string,content:string>>")
    return found.select(*[c for c in found.columns if c not in ("scripts", "parse_error")], F.posexplode("scripts").alias("ord", "s")).select("*", "s.*").drop("s")


def page_links(pages: DataFrame) -> DataFrame:
    """One row for each link block: address, texts, images."""
    from .generic import events, link_blocks

    def read(html):
        return {"links": [{"href": b.hrefs[0], "text": " ".join(b.text), "images": b.images} for b in link_blocks(events(html or ""))]}

    found = map_pages(pages, ["html"], read, "links array<struct<href:string,text:string,images:array<string>>>")
    return found.select(*[c for c in found.columns if c not in ("links", "parse_error")], F.posexplode("links").alias("ord", "l")).select("*", "l.*").drop("l")


def page_metas(pages: DataFrame) -> DataFrame:
    from .lists import page_meta

    schema = "product_name string, price double, seller string, detail_description string, image_url string, shipping_fee double"
    return map_pages(pages, ["html"], lambda h: page_meta(h or ""), schema)


def list_products(pages: DataFrame, limit: int = 50) -> DataFrame:
    """Rows of list pages by their selectors: one row for each page with ``products`` and ``parse_error``.

    ``pages``: html, url, selectors and attributes (maps), default_seller."""
    from .lists import listed

    def read(html, url, selectors, attributes, seller):
        return {"products": listed(html or "", url, dict(selectors), dict(attributes or {}), seller, limit)}

    one = "product_name:string,price:double,shipping_fee:double,seller:string,detail_description:string,product_url:string,image_url:string"
    return map_pages(pages, ["html", "url", "selectors", "attributes", "default_seller"], read, f"products array<struct<{one}>>")


SAVED = (
    "product_name:string,product_type:string,price:double,original_price:double,shipping_fee:double,seller:string,product_url:string,"
    "image_url:string,source_url:string"
)


def saved_products(pages: DataFrame) -> DataFrame:
    """All products of saved pages (html, source_url): ``products`` and ``raw_count``."""
    from .saved import all_products

    def read(html, url):
        products, n = all_products(html or "", url)
        return {"products": products, "raw_count": n}

    return map_pages(pages, ["html", "source_url"], read, f"products array<struct<{SAVED}>>, raw_count bigint")


def saved_ads(pages: DataFrame) -> DataFrame:
    from .saved import ad_products

    return map_pages(pages, ["html", "source_url"], lambda h, u: {"products": ad_products(h or "", u)}, f"products array<struct<{SAVED}>>")


def secondhand_products(pages: DataFrame) -> DataFrame:
    from .saved import secondhand

    one = "product_id:string,product_name:string,price:bigint,product_url:string,image_url:string,sale_status:string"
    return map_pages(pages, ["html"], lambda h: {"products": secondhand(h or "")}, f"products array<struct<{one}>>")


def discovered(pages: DataFrame, top: int = 8) -> DataFrame:
    """Selector hits of pages: ``cards`` and ``hits``."""
    from .saved import discover

    def read(html):
        cards, hits = discover(html or "", top)
        return {"cards": cards, "hits": [{"field": f, "selector": s, "card": c, "value": v} for f, s, c, v in hits]}

    card = "selector:string,match_count:bigint,matching_cards:bigint,sample_values:array<string>"
    return map_pages(pages, ["html"], read, f"cards array<struct<{card}>>, hits array<struct<field:string,selector:string,card:bigint,value:string>>")


def json_nodes(rows: DataFrame, column: str) -> DataFrame:
    """Every value of a JSON document in reading order, with its depth-first ordinal."""
    from .generic import parse_json, walk

    def read(text):
        return {"nodes": [json.dumps(v, ensure_ascii=False) for v in walk(parse_json(text or ""))]}

    found = map_pages(rows, [column], read, "nodes array<string>")
    return found.select(*[c for c in found.columns if c not in ("nodes", "parse_error")], F.posexplode("nodes").alias("ord", "node"))
