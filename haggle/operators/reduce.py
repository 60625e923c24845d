"""Keep-first operators and the reduction of product fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.functions.price import parse_price
from haggle.functions.names import names
from haggle.functions.text import condition_by, condition_marks, let, name_score, query_terms, squash
from haggle.functions.urls import absolute_url, first_parameter, has_parameters, identity, part, unescape_html


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by ``order``; null keys are a key like any other.

    Spark turns the rank limit into a group limit before the exchange, so each task sends on one
    row of a key and a frequent key does not gather in one task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def keep_first_unless_null(df: DataFrame, key: str, order: list) -> DataFrame:
    """Keep-first among rows that have the key; rows without it all stay."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(key).isNull() | (F.col("_rank") == 1)).drop("_rank")


#: Parts into which a key's rows are dealt before they are ranked together.
DEALS = 64


def top_n(df: DataFrame, keys: list, order: list, n: int | Column, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank`` unless it is called ``_rank``.

    A number limits each task before the exchange.  Spark makes no such group limit of a column, so with
    one a key's rows are ranked in up to ``DEALS`` parts first, and only what each part lets through is
    ranked together.
    """
    if isinstance(n, Column):
        part = F.pmod(F.spark_partition_id(), F.lit(DEALS))
        dealt = df.withColumn("_deal", part)
        dealt = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_deal").orderBy(*order)))
        df = dealt.where(F.col("_rank") <= n).drop("_rank", "_deal")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(rank) <= n)
    return kept.drop(rank) if rank == "_rank" else kept


def with_identity(candidates: DataFrame, absolute: bool = False) -> DataFrame:
    """Adds ``url`` (resolved, entities decoded) and ``identity`` (null without a link)."""
    url = absolute_url(F.col("product_url"), F.col("page_url"), absolute)
    if not absolute:
        url = unescape_html(url)
    named = candidates.withColumn("url", url)
    return named.withColumn("identity", identity(F.col("url"), F.col("source"), F.col("product_identity_params")))


def _name_states(names: list[Column]) -> dict[str, Column]:
    """Aggregates from which a group's best name follows: direct names before inferred ones, then by fragment, then by
    place.  Inferred joined names lose two points once the group has shown a direct name, in this fragment or
    before it.

    A fragment with a direct name of its own is never before the first one, so all but the fragments without are
    summed up as maxima.  Those without bring their two best names each, for a group that has a direct name elsewhere."""
    ord_ = F.col("ord")

    def ranked(kind: str, i: int) -> Column:
        n = names[i][kind]
        told = F.struct(n["score"].alias("score"), F.lit(i == 0).alias("direct"), (-ord_).alias("row"), F.lit(i < 2).alias("part"), n["place"].alias("place"), n["name"].alias("name"))
        return F.when(n["name"].isNotNull(), told)

    direct = names[0]["plain"]["name"].isNotNull()
    plain, late = (F.greatest(ranked(kind, 1), ranked(kind, 2)) for kind in ("plain", "late"))
    return {
        "_first": F.min(F.when(direct, ord_)),
        "_direct": F.max(ranked("plain", 0)),
        "_late": F.max(F.when(direct, late)),
        "_plain": F.max(F.when(~direct, plain)),
        "_nameless": F.collect_list(F.when(~direct & plain.isNotNull(), F.struct(ord_.alias("ord"), plain.alias("plain"), late.alias("late")))),
    }


def _best_name() -> Column:
    """The best name of the states of :func:`_name_states`."""
    first = F.col("_first")
    nameless = F.array_max(F.transform("_nameless", lambda n: F.when(n["ord"] >= first, n["late"]).otherwise(n["plain"])))
    return F.when(first.isNull(), F.col("_plain")).otherwise(F.greatest("_direct", "_late", nameless))


def _rewritten(url: Column, params: Column) -> Column:
    """The link with nothing but its identity parameter, where it has one."""
    path = F.regexp_replace(part(url, 3), ";[^/]*$", "")
    keyed = F.when(has_parameters(url), let(first_parameter(url, params), lambda hit: F.concat(part(url, 1), F.lit("://"), part(url, 2), path, F.lit("?"), hit["k"], F.lit("="), hit["v"])))
    return F.coalesce(keyed, url)


def aggregate_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One product of the fragments of each key.

    Best name; lowest price; canonical link before others; first image, seller and currency; condition
    by all texts; up to four further texts as description; the highest confidence plus the
    name's score.  Groups without a usable name go.
    """
    said = [squash(F.col(c)) for c in ("product_name", "description", "seller")]
    rows = rows.withColumns({f"_text{i}": t for i, t in enumerate(said)})
    image = squash(F.col("image_url"))
    # An aggregate works its input out several times, so what is searched for is a column before it.
    # Marks hold no space, so texts may be looked at one fragment at a time.
    marks = condition_marks(F.concat_ws(" ", "_text0", "_text1", "_text2"))
    canonical = (F.size("canonical_product_url_hints") > 0) & F.forall("canonical_product_url_hints", lambda h: F.contains(F.col("url"), h))
    rows = rows.withColumns(
        {
            "_price": F.coalesce(F.col("price"), parse_price(F.col("price_text"))),
            "_image": F.when(~image.rlike(r"\A(?:data:|javascript:|#)"), image),
            "_canonical": canonical,
            **{f"_mark{i}": m for i, m in enumerate(marks)},
        }
    )
    rows = rows.withColumns({f"_names{i}": names(F.col(f"_text{i}"), F.col("query")) for i in range(3)})
    found = [F.col(f"_names{i}") for i in range(3)]
    # Only a description needs the texts of a group side by side; a group comes from one page's capped candidates.
    texts = F.array(*(F.struct(F.col("ord").alias("ord"), F.lit(i).alias("i"), found[i]["clean"].alias("clean")) for i in range(3)))
    first = lambda value, order=F.col("ord"): F.min_by(value, F.when(value.isNotNull(), order))
    grouped = rows.groupBy(*keys).agg(
        F.min("ord").alias("ord"),
        F.min("_price").alias("price"),
        F.min_by("currency", "ord").alias("currency"),
        first(F.col("_text2")).alias("seller"),
        F.bool_or(F.coalesce(*(n["plain"]["name"] for n in found)).isNotNull()).alias("_named"),
        *(state.alias(name) for name, state in _name_states(found).items()),
        *(F.bool_or(f"_mark{i}").alias(f"_mark{i}") for i in range(3)),
        F.collect_list(texts).alias("_texts"),
        first(F.col("url"), F.struct(~F.col("_canonical"), F.col("ord"))).alias("_url"),
        first(F.col("_image")).alias("image_url"),
        F.max("confidence").alias("_confidence"),
        F.count("*").alias("fragment_count"),
        # Rules of the page are the same on all of its rows: one value instead of many aggregates.
        F.first(F.struct(*CARRIED)).alias("_page"),
    ).select("*", "_page.*").drop("_page")
    # Whether a group is named is told without its name, so a query that shows no names gathers none.
    grouped = grouped.where("_named").withColumn("_best", _best_name())
    name = F.substring(F.col("_best.name"), 1, 160)
    clean = F.array_distinct(F.transform(F.array_sort(F.filter(F.flatten("_texts"), lambda t: t["clean"].isNotNull())), lambda t: t["clean"]))
    staged = grouped.withColumn("_others", F.slice(F.filter(clean, lambda t: t != name), 1, 4))
    made = staged.withColumns(
        {
            "product_name": name,
            "condition": condition_by(F.col("_mark0"), F.col("_mark1"), F.col("_mark2"), F.col("default_condition")),
            "description": F.when(F.size("_others") > 0, F.substring(F.concat(name, F.lit(" / "), F.array_join("_others", " / ")), 1, 500)),
            "confidence": F.col("_confidence") + name_score(name, query_terms(F.col("query"))),
            "product_url": _rewritten(F.col("_url"), F.col("product_identity_params")),
            "price_text": F.lit(None).cast("string"),
        }
    )
    return made.drop("_best", "_texts", "_url", "_confidence", "_others", "_named", "_first", "_direct", "_late", "_plain", "_nameless", "_mark0", "_mark1", "_mark2")


#: Columns of the page and its source that every fragment carries along.
CARRIED = (
    "query", "include_used", "max_price", "limit", "page_url", "source_ord", "country", "used_only", "default_condition", "product_identity_params",
    "canonical_product_url_hints", "excluded_url_hints", "ad_url_hints", "allow_ad_products", "require_positive_price",
)


def aggregate_candidates(candidates: DataFrame, absolute: bool = False) -> DataFrame:
    """Fragments of one page and source to products.

    Fragments of equal identity are one group, those without identity a group each; used goods go
    unless asked for; products that then share an identity are merged once more.
    """
    keys = ["request_id", "source", "_group"]
    alone = F.coalesce("identity", F.concat(F.lit("candidate:"), F.col("ord").cast("string")))
    once = aggregate_group(with_identity(candidates, absolute).withColumn("_group", alone), keys)
    once = once.where(F.col("include_used") | (F.col("condition") != "used")).drop("_group")
    # Chosen links keep their identity parameter, so a second merge seldom finds anything: products
    # that stay alone pass by it.
    again = with_identity(once, absolute).withColumn("_group", alone)
    listed = again.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in again.columns if c not in keys))).alias("_all"))
    single = listed.where(F.size("_all") == 1).select(*keys, F.inline("_all"))
    several = aggregate_group(listed.where(F.size("_all") > 1).select(*keys, F.inline("_all")), keys)
    return single.unionByName(with_identity(several, absolute).select(*single.columns)).drop("_group")
