"""Shop-shaped views of the star-schema tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haggle.session import spread
from haggle.sources.registry import SOURCES, sources_frame

#: Tables whose rows are worth dealing out; the others are dimensions.
FACTS = ("lineitem", "orders", "events", "pages", "documents")

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table in FACTS else rows


def newest_first() -> list[Column]:
    """Latest collection first, the row's keys as a total order."""
    return [F.desc("collected_at"), *(F.desc(k) for k in KEYS)]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored products: order lines with their part and supplier."""
    return described(lines(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`described` makes stored products of.  Rows that are sorted or sent before most of them go are these."""
    l, p, s = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = l.join(p, l["l_partkey"] == p["p_partkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    return joined.select(
        *KEYS, "l_tax", "l_quantity", F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), "p_brand", "s_name",
        F.concat(
            F.lit("https://shop"), F.col("l_suppkey") % 5, F.lit(".example.com/products/"), F.col("l_partkey"), F.lit("?utm_source=s"), F.col("l_linenumber")
        ).alias("product_url"),
    )


def data_source() -> Column:
    return _pick(F.col("l_suppkey"), ("click", "view", "purchase", "signup", "import_only"))


def _pick(c: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def described(rows: DataFrame) -> DataFrame:
    """Stored products of :func:`lines`."""
    return rows.select(
        *KEYS,
        "product_name",
        "category",
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax") * 100000).alias("shipping_fee"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("s_name")).alias("seller"),
        _pick(F.col("l_partkey"), ("shopping_mall", "secondhand", "group_buy")).alias("platform"),
        "product_url",
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("https://img.example.com/"), "l_linenumber", F.lit(".jpg"))).alias("image_url"),
        F.when(F.col("l_quantity") <= 40, F.concat_ws(" ", "category", "p_brand")).alias("detail_description"),
        F.col("l_shipdate").alias("collected_at"),
        data_source().alias("data_source"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log: events, of which errors are failed runs."""
    failed = F.col("event_type") == "error"
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("source_name"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        (F.col("user_id") % 20).alias("product_count"),
        F.col("value").alias("response_time_ms"),
        F.when(failed, F.col("props")).alias("error_message"),
        F.col("ts").alias("started_at"),
    )


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with an ordinal: those of pages, then those of listed products."""
    pages = read(spark, sf_dir, "pages").select(F.lit(0).alias("part"), F.col("page_id").alias("n"), "url")
    urls = listing(spark, sf_dir).select("product_url").distinct().select(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("n"), F.col("product_url").alias("url"))
    return pages.union(urls)


def fragments(spark: SparkSession, sf_dir: str, query: str = "small red ring") -> DataFrame:
    """Product candidates as crawled pages give them, with their source's rules."""
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    names = F.array(*(F.lit(s.source) for s in SOURCES))
    mark = F.when(F.col("l_returnflag") == "A", "중고").when(F.col("l_returnflag") == "N", "새상품").otherwise("리퍼")
    # A fragment's place among those of its source and link, told by the part, as the link is: a join that deals rows out by part has
    # them together already, and texts are made of them only then.
    group = Window.partitionBy(F.col("l_suppkey") % 7, "l_partkey").orderBy(*KEYS)
    joined = l.join(p, l["l_partkey"] == p["p_partkey"]).withColumn("ord", F.row_number().over(group).cast("bigint"))
    rows = joined.select(
        F.lit("r1").alias("request_id"),
        F.element_at(names, (F.col("l_suppkey") % 7 + 1).cast("int")).alias("source"),
        F.concat(F.lit("https://shop.example.com/products/"), F.col("l_partkey")).alias("product_url"),
        F.concat("p_name", F.lit(" / "), "p_type", F.lit(" / "), mark).alias("product_name"),
        F.concat("p_name", F.lit(" "), F.floor("l_extendedprice").cast("bigint"), F.lit("원")).alias("price_text"),
        F.lit(None).cast("bigint").alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("https://img.example.com/"), "l_linenumber", F.lit(".jpg"))).alias("image_url"),
        F.concat("p_brand", F.lit(" "), mark).alias("description"),
        F.when(F.col("l_orderkey") % 11 != 0, F.concat(F.lit("Seller "), F.col("l_suppkey"))).alias("seller"),
        F.lit("KRW").alias("currency"),
        (F.col("l_linenumber") % 3).cast("double").alias("confidence"),
        F.lit("https://shop.example.com/").alias("page_url"),
        F.lit(query).alias("query"),
        F.lit(True).alias("include_used"),
        F.lit(None).cast("bigint").alias("max_price"),
        F.lit(20).alias("limit"),
        "ord",
    )
    rules = sources_frame(spark).drop("display_name", "base_url", "product_url_hints", "canonical_product_url_hints", "require_positive_price")
    # Seven registered sites: a table of fixed size.
    rules = rules.withColumn("canonical_product_url_hints", F.array(F.lit("/products/"))).withColumn("require_positive_price", F.lit(True))
    return rows.join(F.broadcast(rules), "source")


LISTING_SQL = """
  listing AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
      p_name AS product_name, p_type AS category, l_extendedprice AS price,
      CASE WHEN l_linenumber % 4 <> 0 THEN l_tax * 100000 END AS shipping_fee,
      CASE WHEN l_orderkey % 11 <> 0 THEN s_name END AS seller,
      ['shopping_mall', 'secondhand', 'group_buy'][(l_partkey % 3 + 1)::INT] AS platform,
      'https://shop' || (l_suppkey % 5) || '.example.com/products/' || l_partkey || '?utm_source=s' || l_linenumber AS product_url,
      CASE WHEN l_linenumber % 2 = 0 THEN 'https://img.example.com/' || l_linenumber || '.jpg' END AS image_url,
      CASE WHEN l_quantity <= 40 THEN p_type || ' ' || p_brand END AS detail_description,
      l_shipdate AS collected_at,
      ['click', 'view', 'purchase', 'signup', 'import_only'][(l_suppkey % 5 + 1)::INT] AS data_source
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""
NEWEST_SQL = "collected_at DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC"
RUNS_SQL = """
  runs AS (
    SELECT event_id AS id, event_type AS source_name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
      user_id % 20 AS product_count, value AS response_time_ms, CASE WHEN event_type = 'error' THEN props END AS error_message, ts AS started_at
    FROM events)
"""
URLS_SQL = "urls AS (SELECT 0 AS part, page_id AS n, url FROM pages UNION ALL SELECT DISTINCT 1, 0::BIGINT, product_url FROM listing)"
FRAGMENTS_SQL = """
  base AS (
    SELECT *, CASE l_returnflag WHEN 'A' THEN '중고' WHEN 'N' THEN '새상품' ELSE '리퍼' END AS mark
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  fragments AS (
    SELECT ['joongna', 'danawa', 'elevenst', 'musinsa', 'kurly', '29cm', 'lotteon'][(l_suppkey % 7 + 1)::INT] AS source,
      (l_suppkey % 7)::INT AS source_ord,
      'https://shop.example.com/products/' || l_partkey AS product_url,
      p_name, p_type, mark, p_name || ' / ' || p_type || ' / ' || mark AS product_name,
      p_name || ' ' || floor(l_extendedprice)::BIGINT || '원' AS price_text, floor(l_extendedprice)::BIGINT AS price,
      CASE WHEN l_linenumber % 2 = 0 THEN 'https://img.example.com/' || l_linenumber || '.jpg' END AS image_url,
      p_brand || ' ' || mark AS description,
      CASE WHEN l_orderkey % 11 <> 0 THEN 'Seller ' || l_suppkey END AS seller,
      (l_linenumber % 3)::DOUBLE AS confidence,
      row_number() OVER (PARTITION BY l_suppkey % 7, l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord
    FROM base)
"""
