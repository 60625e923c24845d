"""The two marketplace APIs as collectors: requests as rows, answers fetched by host, products from the answers.

Credentials are given, or read from the environment; without them a collector is registered but not configured."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from functools import partial
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.sources.api import MOST, ebay_products, elevenst_products
from haggle.sources.fetch import Getter, fetch_pages, http_get
from haggle.sources.registry import encode_plus

# Addresses, scope and variables of the two APIs.
EBAY_TOKEN = "https://api.ebay.com/identity/v1/oauth2/token"
EBAY_SEARCH = "https://api.ebay.com/buy/browse/v1/item_summary/search"
EBAY_SCOPE = "https://api.ebay.com/oauth/api_scope"
EBAY_MARKET = "EBAY_US"
ELEVENST_SEARCH = "http://openapi.11st.co.kr/openapi/OpenApiService.tmall"
TIMEOUT = 15.0


def client_token(client_id: str | None, client_secret: str | None, address: str = EBAY_TOKEN) -> str:
    """An access token for client credentials."""
    if not client_id or not client_secret:
        raise RuntimeError("client id and secret are needed")
    basic = base64.b64encode(f"{client_id}:{client_secret}".encode()).decode()
    form = urlencode({"grant_type": "client_credentials", "scope": EBAY_SCOPE}).encode()
    headers = {"Authorization": f"Basic {basic}", "Content-Type": "application/x-www-form-urlencoded"}
    with urlopen(Request(address, data=form, headers=headers), timeout=TIMEOUT) as answer:
        token = json.loads(answer.read()).get("access_token")
    if not token:
        raise RuntimeError("the answer has no access token")
    return token


def ebay_requests(queries: DataFrame, limit: int = 50, address: str = EBAY_SEARCH) -> DataFrame:
    """``query`` rows with the ``url`` of their search; a page has at most 200 items."""
    return queries.withColumn("url", F.concat(F.lit(f"{address}?q="), encode_plus(F.col("query")), F.lit(f"&limit={min(limit, MOST)}")))


def elevenst_requests(queries: DataFrame, key: str, limit: int = 50, address: str = ELEVENST_SEARCH) -> DataFrame:
    first = f"{address}?{urlencode({'key': key, 'apiCode': 'ProductSearch'})}&keyword="
    return queries.withColumn("url", F.concat(F.lit(first), encode_plus(F.col("query")), F.lit(f"&pageNum=1&pageSize={min(limit, MOST)}")))


def answers(requests: DataFrame, get: Getter, name: str) -> DataFrame:
    """Requests with their answer as column ``name``; one that cannot be had is an error."""
    fetched = fetch_pages(requests, get=get, delay=0)
    text = F.when(F.col("fetch_error").isNotNull(), F.raise_error(F.concat_ws(": ", F.lit("the API did not answer"), "fetch_error"))).otherwise(F.col("html"))
    return fetched.select(*requests.columns, text.alias(name))


def _asked(spark: SparkSession, query: str | None) -> DataFrame:
    if not query:
        raise ValueError("an API collection needs a query")
    return spark.createDataFrame([(query,)], "query string")


def ebay_collector(spark: SparkSession, client_id: str | None, client_secret: str | None, market: str = EBAY_MARKET, search: str = EBAY_SEARCH, token: str = EBAY_TOKEN) -> Callable[[str | None, int], DataFrame]:
    def collect(query: str | None, limit: int) -> DataFrame:
        asked = _asked(spark, query)
        headers = {"Authorization": f"Bearer {client_token(client_id, client_secret, token)}", "X-EBAY-C-MARKETPLACE-ID": market}
        return ebay_products(answers(ebay_requests(asked, limit, search), partial(http_get, timeout=TIMEOUT, headers=headers), "json"), limit)

    return collect


def elevenst_collector(spark: SparkSession, key: str | None, search: str = ELEVENST_SEARCH) -> Callable[[str | None, int], DataFrame]:
    def collect(query: str | None, limit: int) -> DataFrame:
        if not key:
            raise RuntimeError("an API key is needed")
        return elevenst_products(answers(elevenst_requests(_asked(spark, query), key, limit, search), partial(http_get, timeout=TIMEOUT), "xml"), limit)

    return collect


def api_collectors(spark: SparkSession, env: dict[str, str] | None = None) -> dict[str, tuple]:
    """Both collectors as an engine registers them: function, platform, needs a key, configured."""
    env = dict(os.environ) if env is None else env
    client, secret, key = (env.get(n) for n in ("EBAY_CLIENT_ID", "EBAY_CLIENT_SECRET", "ELEVENST_API_KEY"))
    return {
        "ebay_browse": (ebay_collector(spark, client, secret, env.get("EBAY_MARKETPLACE_ID", EBAY_MARKET)), "shopping_mall", True, bool(client and secret)),
        "elevenst": (elevenst_collector(spark, key), "shopping_mall", True, bool(key)),
    }
