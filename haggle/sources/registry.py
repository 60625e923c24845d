"""The marketplaces, their rules, and their search addresses."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.functions.urls import encode_path, encode_plus


@dataclass(frozen=True)
class Source:
    """Rules of one marketplace.  A used-only one of unknown condition sells used goods."""

    source: str
    display_name: str
    base_url: str
    product_url_hints: tuple[str, ...] = ()
    product_identity_params: tuple[str, ...] = ()
    canonical_product_url_hints: tuple[str, ...] = ()
    excluded_url_hints: tuple[str, ...] = ()
    ad_url_hints: tuple[str, ...] = ()
    country: str = "KR"
    used_only: bool = False
    default_condition: str = "new"
    allow_ad_products: bool = True
    require_positive_price: bool = False

    def __post_init__(self):
        if self.used_only and self.default_condition == "unknown":
            object.__setattr__(self, "default_condition", "used")


# The registered marketplaces, in the order of their results.
SOURCES = (
    Source("joongna", "Joonggonara", "https://web.joongna.com", ("/product/",), used_only=True, default_condition="used"),
    Source(
        "danawa",
        "Danawa",
        "https://search.danawa.com",
        ("prod.danawa.com/info/", "pcode="),
        ("pcode",),
        ("prod.danawa.com/info/", "pcode="),
        ("dpg.danawa.com/news", "dpg.danawa.com/bbs"),
        ("ad.danawa.com", "adsmart", "analytics", "linkprice", "11st.co.kr", "coupang.com"),
        allow_ad_products=False,
        require_positive_price=True,
    ),
    Source(
        "elevenst",
        "11st",
        "https://apis.11st.co.kr",
        ("11st.co.kr",),
        ("prdNo", "productNo", "productId", "itemId"),
        ("11st.co.kr",),
        require_positive_price=True,
    ),
    Source("musinsa", "MUSINSA", "https://www.musinsa.com", ("musinsa.com/products/", "/products/"), (), ("musinsa.com/products/",), require_positive_price=True),
    Source("kurly", "Kurly", "https://www.kurly.com", ("kurly.com/goods/", "/goods/"), (), ("kurly.com/goods/",), require_positive_price=True),
    Source(
        "29cm", "29CM", "https://www.29cm.co.kr", ("product.29cm.co.kr/catalog/", "/catalog/"), (), ("product.29cm.co.kr/catalog/",), require_positive_price=True
    ),
    Source("lotteon", "LotteON", "https://www.lotteon.com", ("/p/product/LO",), (), ("www.lotteon.com/p/product/LO",), require_positive_price=True),
)

# What stands before and after the encoded query in each search address.
SEARCH = {
    "joongna": ("/search/", "", encode_path),
    "danawa": ("/dsearch.php?query=", "", encode_plus),
    "elevenst": ("/search/api/tab?poc=mw&tabId=TOTAL_SEARCH&tier=A&searchKeyword=", "&pageNo=1", encode_plus),
    "musinsa": ("/search/goods?keyword=", "&gf=A", encode_path),
    "kurly": ("/search?sword=", "", encode_path),
    "29cm": ("/store/search?keyword=", "&sort=RECOMMENDED&page=1", encode_path),
    "lotteon": ("/csearch/search/search?render=search&platform=pc&q=", "&sort=ranking", encode_path),
}

SCHEMA = ", ".join(
    f"{f.name} {'array<string>' if f.name.endswith(('hints', 'params')) else 'boolean' if 'bool' in str(f.type) else 'string'}" for f in fields(Source)
)


def sources_frame(spark: SparkSession, sources=SOURCES) -> DataFrame:
    """The registry as a small table with ``source_ord``; the number of registered sites bounds it."""
    rows = [(i, *[list(v) if isinstance(v, tuple) else v for v in astuple(s)]) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, f"source_ord int, {SCHEMA}")


def select_sources(include_used: bool = False, name: str | None = None, sources=SOURCES) -> list[Source]:
    """One source by name, or all; used-only ones need ``include_used``."""
    if name is not None and name not in {s.source for s in sources}:
        raise ValueError(f"Unknown source: {name}")
    return [s for s in sources if (name is None or s.source == name) and (include_used or not s.used_only)]


def search_url(source: Column, query: Column) -> Column:
    """The search address of a source for a query."""
    text = F.trim(query)
    chosen: Column | None = None
    for s in SOURCES:
        before, after, encode = SEARCH[s.source]
        url = F.concat(F.lit(s.base_url + before), encode(text), F.lit(after))
        chosen = F.when(source == s.source, url) if chosen is None else chosen.when(source == s.source, url)
    return chosen


def fill_template(template: Column, query: Column, page: Column | None = None) -> Column:
    """``{query}`` and ``{page}`` of a list address filled in."""
    url = F.replace(template, F.lit("{query}"), encode_plus(query))
    return url if page is None else F.replace(url, F.lit("{page}"), page.cast("string"))


def page_urls(templates: DataFrame, max_pages: int) -> DataFrame:
    """One row for each page of (template, query, page_start, page_step)."""
    page = F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1)))
    value = F.col("page_start") + F.col("index") * F.col("page_step")
    return templates.withColumn("index", page).withColumn("page", F.col("index") + 1).withColumn("url", fill_template(F.col("template"), F.col("query"), value))

