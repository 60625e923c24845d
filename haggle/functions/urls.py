"""URL functions.  Expressions where Spark can say it; Arrow UDFs for RFC 3986 joins and entities."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import fold_text, let, present, squash

# Query keys that only track, and keys that name a product.
TRACKING_KEYS = ("adId", "channel", "clid", "entryPoint", "n_ad", "NaPm", "query", "timestamp", "tracking")
PRODUCT_KEYS = ("nvMid", "cat_id", "catalogId", "productId", "itemId", "goodsNo")
PRODUCT_URL = r"(?i)/(?:product|products|goods|item|items|article|articles)/|prod\.danawa\.com/info/|[?&]pcode="

#: scheme, host part, path, query, fragment of an absolute URL.
PARTS = r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"

#: An absolute URL of a host and at most a path: nothing is left out of it but final slashes.
PLAIN = r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#;][^?#;]*\z"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def extract(text: Column, pattern: Column, n: int = 1) -> Column:
    """regexp_extract with a pattern that differs by row; null without a match."""
    return present(F.call_function("regexp_extract", text, pattern, F.lit(n)))


def has_parameters(url: Column) -> Column:
    """Whether :func:`first_parameter` can find any: its patterns differ by row and are compiled for each."""
    return url.contains("?") | url.contains("&")


def first_parameter(url: Column, params: Column) -> Column:
    """``struct<k, v>`` of the first of ``params`` that the address has, undecoded, or null."""
    found = F.transform(params, lambda p: F.struct(p.alias("k"), extract(url, F.concat(F.lit(r"[?&]"), p, F.lit("=([^&#]+)"))).alias("v")))
    return F.try_element_at(F.filter(found, lambda f: f["v"].isNotNull()), F.lit(1))


@F.pandas_udf(StringType())
def _join(value: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else urljoin(b or "", v) for v, b in zip(value, base)], dtype=object)


@F.pandas_udf(StringType())
def unescape_html(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else html.unescape(v))


@F.pandas_udf(StringType())
def canonical_http_url(value: pd.Series) -> pd.Series:
    """The form in which the store keeps URLs: host in lower case, no default port, a path at
    least '/', non-ASCII escaped; null for what is not an absolute http(s) URL."""
    from urllib.parse import quote, urlsplit, urlunsplit

    def one(v):
        if v is None:
            return None
        try:
            u = urlsplit(v.strip())
            host, port = (u.hostname or "").encode("idna").decode(), u.port
        except (ValueError, UnicodeError):
            return None
        if u.scheme not in ("http", "https") or not host:
            return None
        user = u.netloc.rpartition("@")[0]
        port = "" if port is None or (u.scheme, port) in (("http", 80), ("https", 443)) else f":{port}"
        safe = "%/:?#[]@!$&'()*+,;=~"
        return urlunsplit((u.scheme, (user + "@" if user else "") + host + port, quote(u.path or "/", safe), quote(u.query, safe), quote(u.fragment, safe)))

    return value.map(one)


def absolute_url(value: Column, base: Column, absolute: bool = False) -> Column:
    """A link resolved against its page; blank, data:, javascript: and # links are null.

    With ``absolute`` all links are known to be full http(s) URLs, and no UDF is needed.
    """
    text = squash(value)
    real = F.when(~text.rlike(r"\A(?:data:|javascript:|#)"), text)
    return real if absolute else _join(real, base)


def tidy_url(url: Column) -> Column:
    """One spelling for the addresses of a page: scheme and host in lower case, single slashes, no
    final slash, no tracking keys, parameters sorted, no fragment; blank values stay."""
    url = F.trim(url)
    path = F.regexp_replace(F.regexp_replace(part(url, 3), ";[^/]*$", ""), "/+", "/")
    path = F.when(path == "", "").otherwise(F.coalesce(present(F.rtrim(path, F.lit("/"))), F.lit("/")))
    pairs = F.transform(
        F.filter(F.split(part(url, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(p.contains("="), _decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~(p["k"].isin(*TRACKING_KEYS) | p["k"].startswith("utm_"))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encode_plus(p["k"]), F.lit("="), encode_plus(p["v"]))), "&")
    whole = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.lit("?"), query)
    return F.when(url.rlike(PARTS), F.regexp_replace(whole, r"\?\z", "")).otherwise(url)


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def encode_plus(value: Column) -> Column:
    """Form encoding with Python's set of safe characters."""
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def encode_path(value: Column) -> Column:
    """Path encoding: blanks as %20, slashes kept."""
    return F.replace(F.replace(encode_plus(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def query_value(url: Column, key: str) -> Column:
    """The decoded first value of a query key; null if it is missing or empty."""
    return _decoded(present(F.regexp_extract(url, rf"\?(?:[^#]*&)?{re.escape(key)}=([^&#]+)", 1)))


def product_id(url: Column) -> Column:
    """``host:products:N`` on the two store hosts, else ``host:key:value`` of the first known key."""
    url = F.trim(url)
    host = F.lower(part(url, 2))
    number = present(F.regexp_extract(part(url, 3), "/products/([0-9]+)", 1))
    store = F.when(host.contains("smartstore.naver.com") | host.contains("brand.naver.com"), F.concat(host, F.lit(":products:"), number))
    keyed = [F.concat(host, F.lit(f":{k}:"), query_value(url, k)) for k in PRODUCT_KEYS]
    return F.coalesce(store, *keyed)


def identity(url: Column, source: Column, params: Column) -> Column:
    """What makes two links of a source the same product: its first identity parameter, else the
    address without query and final slash.  ``url`` is resolved and unescaped."""
    path = F.rtrim(F.regexp_replace(part(url, 3), ";[^/]*$", ""), F.lit("/"))
    address = F.when(url.rlike(PLAIN), F.rtrim(url, F.lit("/"))).when(url.rlike(PARTS), F.concat(part(url, 1), F.lit("://"), part(url, 2), path)).otherwise(url)
    keyed = F.when(has_parameters(url), let(first_parameter(url, params), lambda hit: F.concat(source, F.lit(":"), hit["k"], F.lit(":"), hit["v"])))
    return F.coalesce(keyed, F.concat(source, F.lit(":url:"), address))


def identity_key(row: dict[str, Column], whole: Column) -> Column:
    """``struct<kind, value>``: product id, else tidy URL, else seller and name, else file and
    name, else the whole row.  ``row`` has product_url, seller, product_name and source_file."""
    full = lambda c: F.trim(row[c]) != ""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    url = row["product_url"]
    return (
        F.when(
            full("product_url"),
            let(product_id(url), lambda found: F.when(found.isNotNull(), pair("product_id", found)).otherwise(pair("product_url", tidy_url(url)))),
        )
        .when(
            full("seller") & full("product_name"),
            pair("seller_name", F.concat(fold_text(row["seller"]), F.lit("::"), fold_text(row["product_name"]))),
        )
        .when(
            full("source_file") & full("product_name"),
            pair("source_file_name", F.concat(row["source_file"], F.lit("::"), fold_text(row["product_name"]))),
        )
        .otherwise(pair("unknown", whole))
    )


def looks_like_product(url: Column, hints: Column | None = None) -> Column:
    hit = url.rlike(PRODUCT_URL)
    if hints is not None:
        hit = F.exists(hints, lambda h: F.contains(url, h)) | hit
    return (url != "") & hit


def valid_http(url: Column) -> Column:
    """Null is valid."""
    return url.isNull() | url.rlike(r"\A(?i:https?)://[^/?#]+")


def bare_host(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.lower(F.regexp_extract(part(url, 2), r"\A(?:[^@]*@)?([^:]*)", 1))


def host_suffixes(host: Column) -> Column:
    """A host and all domains it is under."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def host_matches(url: Column, domain: Column) -> Column:
    """The host is the domain or under it."""
    host = bare_host(url)
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def site_product_id(url: Column, site: str) -> Column:
    """A site's product number in its link; ``url`` is unescaped."""
    patterns = {
        "kurly": r"(?:\A|/)goods/([0-9]+)(?:[/?#]|\z)",
        "lotteon": r"(?i)/p/product/(LO[^/?#]+)",
        "29cm": r"(?i)(?:product\.29cm\.co\.kr/catalog/([0-9]+))",
    }
    found = present(F.regexp_extract(url, patterns[site], 1))
    if site == "29cm":
        found = F.coalesce(found, present(F.regexp_extract(url, r"(?i)/catalog/([0-9]+)(?:[/?#]|\z)", 1)))
    return found


def canonical_site_url(product: Column, site: str) -> Column:
    base = {"lotteon": "https://www.lotteon.com/p/product/", "29cm": "https://product.29cm.co.kr/catalog/"}
    return F.concat(F.lit(base[site]), product)
