"""Fetching pages as a DataFrame operation: addresses in, pages out.

Addresses of one host stay in one task and are asked one after the other with a pause between them, so
a host never sees more than one request at a time however many executors there are; different hosts
go on side by side.  A page that cannot be had is a row with its error, not a failed job."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

AGENT = "haggle/1.0"
#: What a getter gives: status, final address, title and text.
Getter = Callable[[str], tuple[int | None, str, str, str]]
FETCHED = "http_status int, final_url string, title string, html string, fetch_error string"
TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)


def http_get(url: str, timeout: float = 30.0, headers: dict[str, str] | None = None) -> tuple[int | None, str, str, str]:
    """A plain request."""
    with urlopen(Request(url, headers={"User-Agent": AGENT, **(headers or {})}), timeout=timeout) as answer:
        text = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        found = TITLE.search(text)
        return answer.status, answer.url, " ".join(found[1].split()) if found else "", text


def browser_get(url: str, timeout: float = 30.0, price_wait: float = 5.0) -> tuple[int | None, str, str, str]:
    """A page as a browser shows it once a won price stands in it; needs the optional playwright package."""
    try:
        from playwright.sync_api import Error, sync_playwright
    except ImportError as error:
        raise RuntimeError("rendering pages needs playwright and its browser") from error
    with sync_playwright() as tools:
        browser = tools.chromium.launch(headless=True)
        try:
            page, answer = browser.new_page(), None
            try:
                answer = page.goto(url, wait_until="domcontentloaded", timeout=timeout * 1000)
                page.get_by_text(re.compile(r"[0-9][0-9,\s]*\s*원")).first.wait_for(timeout=price_wait * 1000)
            except Error:
                pass  # what has been loaded by then is the page
            return answer.status if answer else None, page.url, page.title(), page.content()
        finally:
            browser.close()


def host_of(url) -> Column:
    """The host and port of an address in lower case, without user names; '' if it has none."""
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#]*)", 1))


def fetched_row(url: str | None, way: Getter) -> tuple:
    """``http_status, final_url, title, html, fetch_error`` of an address; a failure is its row's error."""
    try:
        if url is None:
            raise ValueError("no address")
        return (*way(url), None)
    except Exception as error:
        return (None, url, None, None, f"{type(error).__name__}: {error}")


def fetch_pages(addresses: DataFrame, get: Getter = http_get, render: Getter = browser_get, delay: float = 1.0) -> DataFrame:
    """``addresses`` (url, and whatever else) with ``http_status, final_url, title, html, fetch_error``.

    Rows whose column ``rendered`` is true are shown by a browser, all others fetched.  Columns of the new
    names are replaced; a null address is an error of its row."""
    kept = [c for c in addresses.columns if c not in [f.name for f in _parse_datatype_string(FETCHED)]]
    made = _parse_datatype_string(FETCHED)
    kind = StructType([*(addresses.schema[c] for c in kept), *made.fields])
    arrow = to_arrow_schema(made)
    at, shown = kept.index("url"), kept.index("rendered") if "rendered" in kept else None

    def run(batches):
        asked: dict[str, float] = {}
        for batch in batches:
            rows = []
            for i, url in enumerate(batch.column(at).to_pylist()):
                host = batch.column(len(kept))[i].as_py() or ""
                pause = asked.get(host, 0.0) + delay - time.monotonic() if host in asked else 0.0
                if pause > 0:
                    time.sleep(pause)
                rows.append(fetched_row(url, render if shown is not None and batch.column(shown)[i].as_py() else get))
                asked[host] = time.monotonic()
            arrays = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], [*kept, *arrow.names])

    dealt = addresses.select(*kept, host_of(F.col("url")).alias("_host")).repartition("_host").sortWithinPartitions("_host", "url")
    return dealt.mapInArrow(run, kind)


def joined_answers(answers: DataFrame, by: list[str]) -> DataFrame:
    """The JSON answers of one search (page_no, url, html) as one page ``{"pages": [...]}``, in page order; an
    answer that is no JSON has a null payload."""
    payload = F.when(F.try_parse_json("html").isNotNull(), F.col("html")).otherwise("null")
    one = F.concat(F.lit('{"page_no":'), "page_no", F.lit(',"url":'), F.regexp_extract(F.to_json(F.struct(F.coalesce("url", F.lit("")).alias("u"))), r'(?s)\A\{"u":(.*)\}\z', 1), F.lit(',"payload":'), payload, F.lit("}"))
    # A search has a handful of pages.
    grouped = answers.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page_no", one.alias("one")))).alias("all"))
    return grouped.select(*by, F.concat(F.lit('{"pages":['), F.array_join(F.transform("all", lambda x: x["one"]), ","), F.lit("]}")).alias("html"))
