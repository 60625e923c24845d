"""What results are written as: JSON files, review drafts and text reports.

A crawl result is one document by its nature, so its rows are gathered into one, which the request's limit
bounds; a saved-page result is one file, written line by line.  Everything else is written by Spark as it is."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haggle.session import PLACED_BY_TASKS

KEEP_NULLS = {"ignoreNullFields": "false"}
RESULT = ("product_name", "price", "currency", "source", "seller", "condition", "country", "product_url", "image_url", "description")


def _listed(rows: DataFrame, order: list[str], columns: list[str], by: list[str]) -> DataFrame:
    item = F.struct(*order, F.struct(*columns).alias("row"))
    gathered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    return gathered.select(*by, F.transform("_all", lambda x: x["row"]).alias("products"))


def write_result(products: DataFrame, summary: DataFrame, order: list[str], path: str) -> None:
    """``{summary, products}`` as one JSON file: one summary row and the products in ``order``, a line for each.

    Lines are sorted and written one after the other, so the file's size is not the size of a row."""
    said = lambda x: F.to_json(x, KEEP_NULLS)
    listed = products.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("n"), said(F.struct(*products.columns)).alias("value"))
    listed = listed.withColumn("value", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "value"))
    first = summary.select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.concat(F.lit('{"summary":'), said(F.struct("*")), F.lit(',"products":[')).alias("value"))
    last = summary.select(F.lit(2).alias("part"), F.lit(0).alias("n"), F.lit("]}").alias("value"))
    lines = first.unionByName(listed).unionByName(last).repartition(1).sortWithinPartitions("part", "n")
    lines.select("value").write.mode("overwrite").text(path)


def write_list(products: DataFrame, path: str) -> None:
    """One JSON object in a line for each product, written in parallel."""
    products.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def crawl_documents(products: DataFrame, status: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """``request_id, value``: each request's result as JSON, products in rank order; counters as debug."""
    columns = [c for c in RESULT if c in products.columns]
    listed = _listed(products, ["rank"], columns, ["request_id"])
    whole = status.join(listed, "request_id", "left").withColumn("products", F.coalesce("products", F.array().cast(listed.schema["products"].dataType)))
    names = ["query", "status", "error", "product_count", "products", "errors"]
    if counters is not None:
        shown = [c for c in counters.columns if c not in ("request_id", "source_ord")]
        debug = counters.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct(*shown)))).alias("debug"))
        whole, names = whole.join(debug, "request_id", "left"), [*names, "debug"]
    return whole.select("request_id", F.to_json(F.struct(*names), KEEP_NULLS).alias("value"))


def write_files(texts: DataFrame, folder: str) -> None:
    """Texts (name, value) as files in a folder, one for each, made by the tasks that hold the rows.

    A name is a path beneath the folder, and no two rows have the same.  Spark's writers name folders only, and on a
    local disk Hadoop starts four processes for each file they write; these cost more than the file.
    A file is put in place when it is whole, so a task that is tried again leaves the same files."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

    def put(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                above, _, last = f"{root}/{name}".rpartition("/")
                if above not in made:
                    store.create_dir(above)
                    made.add(above)
                unfinished = f"{above}/.{last}.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished, compression=None) as out:
                    out.write(value.as_buffer())
                store.move(unfinished, f"{above}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    made = texts.select("name", F.col("value").cast("binary").alias("value")).mapInArrow(put, "files bigint")
    made.write.format("noop").mode("overwrite").save()


def dump_pages(pages: DataFrame, path: str) -> None:
    """Fetched pages (source, html) as files for debugging: a folder for each source, a file for each page."""
    shown = pages.where("html is not null").select("source", F.col("html").alias("value"))
    shown.write.mode("overwrite").partitionBy("source").options(maxRecordsPerFile=1, lineSep="\n", **PLACED_BY_TASKS).text(path)


def file_name(query: str) -> str:
    """A query as a file name: other signs than letters and digits become '_'."""
    return "".join(c if c.isalnum() else "_" for c in query).strip("_") or "query"


def draft_config(name: str, url: str, cards: list[dict], fields: dict[str, list[dict]], seller: str = "Saved pages") -> dict:
    """A review draft of a source: selector candidates only, never approved."""
    note = "Saved HTML analysis only. Automated collection and reuse are not approved."
    source = {"name": name, "collection_method": "approved_html", "seller": seller, "list_urls": [url], "permission": {"approved": False, "note": note}}
    return {"sources": [source | {"selectors": {}, "attributes": {}, "selector_candidates": {"product_card": cards, **fields}}]}


def draft_yaml(draft: dict) -> str:
    import yaml

    return yaml.safe_dump(draft, allow_unicode=True, sort_keys=False)


def text_report(name: str, url: str, cards: list[dict], fields: dict[str, list[dict]]) -> str:
    """The selector candidates for a reader."""
    lines = [f"source: {name}", f"address: {url}", "approved: no"]
    for title, found in {"product_card": cards, **fields}.items():
        lines.append(f"\n{title}:")
        lines += [f"  {c['selector']}  matches {c['match_count']}, cards {c['matching_cards']}, e.g. {', '.join(map(str, c['sample_values'][:3]))}" for c in found] or ["  none"]
    return "\n".join(lines)


def discovery(pages: DataFrame, top: int = 8) -> tuple[list[dict], dict[str, list[dict]]]:
    """Card and field selectors of one saved page (page_id, html), for drafts and reports."""
    from haggle.extract.frames import discovered
    from haggle.operators.summary import selector_ranking

    found = discovered(pages, top).persist()
    try:
        cards = [r.asDict() for row in found.select("cards").take(1) for r in row["cards"]]
        hits = found.select("page_id", F.posexplode("hits").alias("ord", "h")).select("page_id", "ord", "h.*")
        fields: dict[str, list[dict]] = {}
        for r in selector_ranking(hits, top).orderBy("field", "rank").collect():  # top selectors of five fields
            fields.setdefault(r["field"], []).append({k: r[k] for k in ("selector", "match_count", "matching_cards", "sample_values")})
        return cards, fields
    finally:
        found.unpersist()
