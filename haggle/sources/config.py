"""Configurations of approved sources, checked before any page is read."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.functions.urls import bare_host, host_suffixes

NEEDED = ("product_card", "product_name", "price", "product_url")


@dataclass(frozen=True)
class SiteConfig:
    """How a site's list pages are read, and who allowed it."""

    name: str
    selectors: dict[str, str]
    attributes: dict[str, str] = field(default_factory=dict)
    domains: tuple[str, ...] = ()
    list_urls: tuple[str, ...] = ()
    search_url_template: str = ""
    collection_method: str = "approved_html"
    api_collector: str | None = None
    approved: bool = False
    permission_note: str | None = None
    permission_reference: str | None = None
    default_seller: str | None = None
    page_start: int = 1
    page_param_step: int = 1


def _text(value) -> str:
    return "" if value is None else str(value).strip()


#: What a configuration's value becomes, field by field; other fields keep their defaults.
_KINDS = {
    "name": _text,
    "search_url_template": _text,
    "collection_method": _text,
    "selectors": lambda m: {str(k): str(v) for k, v in (m or {}).items() if v},
    "attributes": lambda m: {str(k): str(v) for k, v in (m or {}).items() if v},
    "domains": lambda v: tuple(d.lower() for d in map(_text, v or ()) if d),
    "list_urls": lambda v: tuple(filter(None, map(_text, v or ()))),
    "api_collector": lambda v: v,
    "page_start": int,
    "page_param_step": int,
}


def _read(raw: dict) -> SiteConfig:
    given = {"selectors": None, "collection_method": None, **{k: v for k, v in raw.items() if k in _KINDS}}
    values = {k: _KINDS[k](v) for k, v in given.items()}
    allowed = raw.get("permission") or {}
    # Only a plain yes approves a source.
    values["approved"] = allowed.get("approved") is True
    values |= {f"permission_{k}": allowed[k] for k in ("note", "reference") if k in allowed}
    seller = next((raw[k] for k in ("default_seller", "seller") if raw.get(k)), None)
    return SiteConfig(**{"name": "", **values, "default_seller": seller})


def _need(ok, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _permitted(c: SiteConfig) -> None:
    _need(c.permission_note or c.permission_reference, f"{c.name}: the permission needs a note or a reference")


def _selected(c: SiteConfig) -> None:
    missing = [f for f in NEEDED if f not in c.selectors]
    _need(not missing, f"{c.name}: selectors are missing: {', '.join(missing)}")


def list_site(raw: dict) -> SiteConfig:
    """A site for approved list pages: approved, permitted, with selectors and domains."""
    c = _read(raw)
    _need(c.approved, f"{c.name or 'a source'} is not approved")
    _selected(c)
    _need(c.domains, f"{c.name}: domains are missing")
    _permitted(c)
    return c if c.name else SiteConfig(**{**c.__dict__, "name": c.domains[0]})


def auto_source(raw: dict) -> SiteConfig:
    """A source of the multi-source collection; unapproved ones are only checked for name and method."""
    c = _read(raw)
    _need(c.name, "a source needs a name")
    _need(c.collection_method in ("api", "approved_html"), f"{c.name}: unknown collection method {c.collection_method!r}")
    if c.approved:
        _permitted(c)
        if c.collection_method == "api":
            _need(c.api_collector, f"{c.name}: api_collector is missing")
        else:
            _selected(c)
            _need(c.list_urls, f"{c.name}: list_urls are missing")
    return c


def paged_source(raw: dict) -> SiteConfig:
    """A source of paged list pages."""
    c = _read(raw)
    _need(c.approved, f"{c.name or 'a source'} is not approved")
    _permitted(c)
    _selected(c)
    _need("{query}" in c.search_url_template, f"{c.name}: search_url_template has no {{query}}")
    _need(c.name, "a source needs a name")
    return c


def choose_source(config: dict, name: str | None = None) -> SiteConfig:
    """The only source of a configuration, or the named one."""
    sources = [paged_source(s) for s in config.get("sources") or ()]
    _need(sources, "no approved source is configured")
    if name is not None:
        found = [s for s in sources if s.name == name]
        _need(found, f"no source named {name}")
        return found[0]
    _need(len(sources) == 1, "several sources are configured; name one")
    return sources[0]


def load_yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def configs_frame(spark: SparkSession, configs: list[SiteConfig]) -> DataFrame:
    """Configurations as a small table with ``config_ord``; configured sites bound it."""
    rows = [(i, c.name, list(c.domains) or [urlsplit(u).hostname for u in c.list_urls], c.selectors, c.attributes, c.default_seller) for i, c in enumerate(configs)]
    schema = "config_ord int, name string, domains array<string>, selectors map<string,string>, attributes map<string,string>, default_seller string"
    return spark.createDataFrame(rows, schema)


def configured_pages(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """Pages with the first configuration of their host; a page of an unknown host has none.

    Each host is looked up once, by itself and the domains it is under, so the join is one by equal keys; the pages
    then take their host's configuration."""
    domains = configs.select("config_ord", F.explode("domains").alias("domain")).groupBy("domain").agg(F.min("config_ord").alias("config_ord"))
    hosted = pages.withColumn("_host", bare_host(F.col("url")))
    asked = hosted.select("_host").where("_host <> ''").distinct().select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
    known = asked.join(domains, "domain").groupBy("_host").agg(F.min("config_ord").alias("config_ord"))
    return hosted.join(known, "_host", "left").drop("_host").join(F.broadcast(configs.drop("domains")), "config_ord", "left")
