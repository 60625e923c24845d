"""Functions, reduction, plans, store and streams on literal rows."""

import json
import random
from datetime import datetime
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from haggle.engine import Engine
from haggle.extract import frames
from haggle.functions import names as N
from haggle.functions import price as P
from haggle.functions import text as T
from haggle.functions import urls as U
from haggle.operators import filters, reduce, summary
from haggle.operators.store import ProductStore
from haggle.plans import collect, crawl, merge, outputs
from haggle.sources import api, config, files, registry
from haggle.streaming import imports
from tests.test_extract import ITEMS, saved_page


def values(spark, expression, texts, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("t"))).orderBy("i").collect()]


# -- functions -------------------------------------------------------------------------------------------


def test_squash(spark):
    texts = [" a 　 b\x1c\n", "   ", "", None, "x"]
    assert values(spark, T.squash, texts) == [" ".join(t.split()) or None if t is not None else None for t in texts]


@pytest.mark.parametrize(
    "text, plain, structured",
    [
        ("1,077,870원", 1077870, 1077870), ("정가 20,000 원 할인 9,900원", 9900, 9900), ("12,345 and 1,200", 1200, 1200), ("650000", None, 650000), ("19.99", None, None),
        ("1,077.50", 1077, 1077), ("무료나눔 1,000원", None, None), ("가격 협의 500원", None, None), ("-5", None, None), (None, None, None), ("", None, None), ("원", None, None),
    ],
)
def test_prices(spark, text, plain, structured):
    rows = spark.createDataFrame([(text,)], "t string").select(P.parse_price(F.col("t")), P.parse_price(F.col("t"), structured=True)).first()
    assert tuple(rows) == (plain, structured)


def test_other_numbers(spark):
    assert values(spark, P.lenient_number, ["-5", "1.2.3", "12,900원", "", None]) == [5.0, None, 12900.0, None, None]
    assert values(spark, P.positive_number, ["1,200", "0", " 7 ", "x", None]) == [1200, None, 7, None, None]
    assert values(spark, P.structured_number, [-1.5, 2.9], "double") == [None, 2]
    assert values(spark, P.block_price, ["a 1,000원 b 2 000 원", "가격 제안", "none"]) == ["2 000 원", "가격 제안", None]


def test_names(spark):
    texts = ["삼성 갤럭시 S25", "12,345원", "판매가: 1,000", "77몰", "1위", "후면:2억", "티타늄 블랙", "ab", "닫기", "블랙 256GB", None]
    assert values(spark, T.clean_name, texts) == ["삼성 갤럭시 S25", *[None] * 8, "블랙 256GB", None]
    score = lambda c: T.name_score(c, T.query_terms(F.lit("갤럭시 s25")))
    got = values(spark, score, ["삼성전자 갤럭시 S25 울트라 256GB", "티타늄 블랙"])
    assert got == pytest.approx([2 + 1 + 2 + 2 + 6 + 22 / 120, 2 - 50 + 6 / 120])
    (parts,) = values(spark, T.name_parts, ["삼성전자 / 갤럭시 / S25 / 1위 / 갤럭시"])
    assert [(p.name, p.joined) for p in parts] == [
        ("삼성전자", False), ("갤럭시", False), ("S25", False), ("삼성전자 갤럭시", True), ("삼성전자 갤럭시 S25", True), ("삼성전자 갤럭시 S25 갤럭시", True),
        ("갤럭시 S25", True), ("갤럭시 S25 갤럭시", True), ("S25 갤럭시", True),
    ]


def test_conditions_and_shipping(spark):
    assert values(spark, lambda c: T.condition_of(c, F.lit("new")), ["최상급", "Renewed", "미개봉", "x"]) == ["used", "refurbished", "new", "new"]
    assert values(spark, T.marketplace_condition, ["Renewed", "Pre-Owned", "Seller refurbished", "x", None]) == ["new", "used", "refurbished", "unknown", "unknown"]
    assert values(spark, T.shipping_from_page, ["무료배송", "배송비 2,500원", "x"]) == [0.0, 2500.0, None]
    assert values(spark, T.shipping_from_field, ["Free", "무료", "3,000원", None]) == [0.0, 0.0, 3000.0, None]
    assert values(spark, T.casefold, ["Straße", "ẞ"]) == ["strasse", "ss"]


def test_tidy_url_agrees_with_the_standard_library(spark):
    rng = random.Random(1)

    def one():
        path = "".join(rng.choice(["/", "//", "a", "B", ".", "-", "%20", ";p"]) for _ in range(rng.randrange(8)))
        pairs = ["=".join(rng.sample(["a", "utm_x", "query", "b%3D", "Z", "1+1", "é", "~*", ""], 2)) for _ in range(rng.randrange(4))]
        return f"{rng.choice(['http', 'HTTPS'])}://Shop.example.com{'/' + path if path else ''}" + ("?" + "&".join(pairs) if pairs else "") + rng.choice(["", "#f"])

    def want(url):
        p = urlparse(url.strip())
        kept = sorted((k, v) for k, vs in parse_qs(p.query, keep_blank_values=True).items() for v in vs if k not in U.TRACKING_KEYS and not k.startswith("utm_"))
        path = p.path
        while "//" in path:
            path = path.replace("//", "/")
        return urlunparse((p.scheme.lower(), p.netloc.lower(), (path.rstrip("/") or "/") if path else "", "", urlencode(kept), ""))

    urls = [one() for _ in range(400)]
    assert values(spark, U.tidy_url, urls) == [want(u) for u in urls]


def test_url_functions(spark):
    assert values(spark, lambda c: U.absolute_url(c, F.lit("https://a.example/x/y?z")), ["/p", "q", "//b.example/r", "../s", "data:x", "#", " ", None]) == [
        urljoin("https://a.example/x/y?z", "/p"), "https://a.example/x/q", "https://b.example/r", "https://a.example/s", None, None, None, None,
    ]
    assert values(spark, U.product_id, ["https://smartstore.naver.com/m/products/12?x", "https://h.example/a?b=1&nvMid=9", "https://h.example/products/3", "x"]) == [
        "smartstore.naver.com:products:12", "h.example:nvMid:9", None, None,
    ]
    ident = lambda c: U.identity(c, F.lit("danawa"), F.array(F.lit("pcode")))
    assert values(spark, ident, ["https://p.example/i?k=1&pcode=7&x", "https://p.example/i/?k=1", None]) == ["danawa:pcode:7", "danawa:url:https://p.example/i", None]
    assert values(spark, U.canonical_http_url, ["HTTPS://Example.com:443", "http://a.example/é", "/x", None]) == ["https://example.com/", "http://a.example/%C3%A9", None, None]
    assert values(spark, lambda c: U.host_matches(c, F.lit("b.example")), ["https://a.b.example/", "https://ab.example/", "https://b.example:8/"]) == [True, False, True]
    assert values(spark, lambda c: U.site_product_id(c, "29cm"), ["/catalog/12?x", "https://product.29cm.co.kr/catalog/3", "/x"]) == ["12", "3", None]
    asked = spark.createDataFrame([(s.source,) for s in registry.SOURCES], "s string").select(registry.search_url(F.col("s"), F.lit(" 갤럭시 S25 "))).collect()
    assert asked[1][0].endswith("query=%EA%B0%A4%EB%9F%AD%EC%8B%9C+S25") and asked[4][0].endswith("sword=%EA%B0%A4%EB%9F%AD%EC%8B%9C%20S25")


def test_identity_keys(spark):
    rows = [("https://brand.naver.com/a/products/5?utm_x=1", "s", "n", "f"), ("HTTP://A.example/x/?b=2&a=1", None, None, None), (" ", " Shop ", "NAME  x", None), (None, None, "n", "f.html"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "product_url string, seller string, product_name string, source_file string")
    key = U.identity_key({c: F.col(c) for c in df.columns}, F.to_json(F.struct(*df.columns)))
    assert [tuple(r[0]) for r in df.select(key).collect()] == [
        ("product_id", "brand.naver.com:products:5"), ("product_url", "http://a.example/x?a=1&b=2"), ("seller_name", "shop::name x"), ("source_file_name", "f.html::n"), ("unknown", "{}"),
    ]


# -- reduction ---------------------------------------------------------------------------------------------


def candidates(spark, rows, source="danawa", query="갤럭시 S25", include_used=False, limit=20, max_price=None):
    shape = "product_name string, price_text string, product_url string, image_url string, description string, seller string, price bigint, confidence double"
    base = ("product_name", "price_text", "product_url", "image_url", "description", "seller", "price")
    data = [tuple(r.get(c) for c in base) + (float(r.get("confidence", 0)), i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, shape + ", ord bigint")
    rules = registry.sources_frame(spark).where(F.col("source") == source)
    return df.crossJoin(rules).select(
        *df.columns, "source", *(c for c in reduce.CARRIED if c in rules.columns), F.lit("KRW").alias("currency"), F.lit("r1").alias("request_id"), F.lit(query).alias("query"),
        F.lit(include_used).alias("include_used"), F.lit(max_price).cast("bigint").alias("max_price"), F.lit(limit).alias("limit"), F.lit("https://search.danawa.com/dsearch.php").alias("page_url"),
    )


PCODE = "https://prod.danawa.com/info/?pcode="


def test_fragments_of_one_product_merge(spark):
    rows = [
        {"product_name": "후면:2억 화소+1,000만화소", "price_text": "1,473,160원", "product_url": f"{PCODE}1&keyword=x", "description": "후면:2억 화소 / 삼성전자 / 갤럭시 / S25 / 울트라 256GB, 자급제"},
        {"product_name": "New 새로워진 상품비교 기능", "price_text": "1,400,000원", "product_url": f"{PCODE}1&amp;cate=2", "image_url": "data:x", "description": "닫기 / 77몰", "confidence": 4},
        {"product_name": "혜택 최저가", "price_text": "9,999,999원", "product_url": "/info/?pcode=1", "image_url": " /a.jpg ", "seller": " 가게  하나 "},
    ]
    (r,) = reduce.aggregate_candidates(candidates(spark, rows)).collect()
    assert (r.product_name, r.product_url, r.price, r.image_url, r.seller, r.fragment_count) == ("삼성전자 갤럭시 S25 울트라 256GB, 자급제", f"{PCODE}1", 1400000, "/a.jpg", "가게 하나", 3)
    # 'New ...' as a text is no evidence; 자급제 is.
    assert r.condition == "new" and r.description.startswith(r.product_name + " / ")


def test_direct_names_beat_joined_ones(spark):
    name = "삼성전자 갤럭시 S25 울트라 256GB, 자급제"
    rows = [{"product_name": name, "price_text": "1원", "product_url": f"{PCODE}1", "description": f"갤럭시S25 울트라 256GB, 자급제 / {name} / 출시가: 1,698,400원"}]
    assert reduce.aggregate_candidates(candidates(spark, rows)).first().product_name == name
    only = [{"product_name": "티타늄 블랙", "price_text": "1원", "product_url": f"{PCODE}1"}, {"product_name": "1,473,160원", "product_url": f"{PCODE}1"}]
    found = reduce.aggregate_candidates(candidates(spark, only)).collect()
    assert found == []


def test_used_goods_and_groups_without_a_link(spark):
    rows = [{"product_name": "최상급,중고", "product_url": f"{PCODE}1"}, {"product_name": "이름 하나"}, {"product_name": "이름 하나"}]
    assert reduce.aggregate_candidates(candidates(spark, rows)).count() == 2
    used = reduce.aggregate_candidates(candidates(spark, rows, include_used=True))
    assert used.where("condition = 'used'").count() == 1 and used.count() == 3


def test_crawl_filters_normalises_and_limits(spark):
    rows = [
        {"product_name": "갤럭시 하나 256GB", "price_text": "100,000원", "product_url": f"{PCODE}1", "image_url": "/1.jpg"},
        {"product_name": "갤럭시 둘 256GB", "price_text": "0원", "product_url": f"{PCODE}2"},
        {"product_name": "갤럭시 셋 256GB", "price_text": "900,000원", "product_url": f"{PCODE}3"},
        {"product_name": "갤럭시 넷 256GB", "price_text": "50,000원", "product_url": "https://ad.danawa.com/prod.danawa.com/info/?pcode=4"},
        {"product_name": "갤럭시 다섯 256GB", "price_text": "60,000원", "product_url": "https://dpg.danawa.com/news?pcode=5"},
        {"product_name": "갤럭시 여섯 S25", "price_text": "70,000원", "product_url": f"{PCODE}6", "confidence": 9},
    ]
    got = crawl.crawl_products(candidates(spark, rows, max_price=500000)).orderBy("rank").collect()
    assert [(r["rank"], r.product_name, r.image_url) for r in got] == [(1, "갤럭시 여섯 S25", None), (2, "갤럭시 하나 256GB", "https://search.danawa.com/1.jpg")]
    assert crawl.crawl_products(candidates(spark, rows, limit=1)).count() == 1
    assert crawl.crawl_products(candidates(spark, [])).count() == 0


def test_keep_first_with_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 4), ("a", 3)], "k string, o int")
    assert sorted(map(tuple, reduce.keep_first(df, ["k"], ["o"]).collect()), key=str) == [("a", 3), (None, 1)]
    assert reduce.keep_first_unless_null(df, "k", ["o"]).count() == 3
    assert reduce.top_n(df, ["k"], ["o"], 1).count() == 2


def test_engine_crawl(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    card = lambda i, t, p: f'<li><a href="https://prod.danawa.com/info/?pcode={i}">{t}</a><b>{p}</b></li>'
    asked = e.requests("갤럭시 S25", limit=5)
    assert asked.count() == 6 and e.requests("x", source="joongna").count() == 0
    for bad in (lambda: e.requests(" "), lambda: e.requests("x", limit=0), lambda: e.requests("x", source="nowhere")):
        with pytest.raises(ValueError):
            bad()
    pages = spark.createDataFrame(
        [("danawa", card(1, "삼성 갤럭시 S25 256GB", "1,077,870원") + card(2, "최상급,중고", "900,000원"), "t", 200, None), ("kurly", "<p>", "Access Denied", 200, None),
         ("29cm", "", "", 500, None), ("musinsa", None, None, None, "timeout")],
        "source string, html string, title string, http_status int, render_error string",
    )
    products, counters, status = e.crawl(asked, pages)
    assert [(r.source, r.product_name, r.condition) for r in products.collect()] == [("danawa", "삼성 갤럭시 S25 256GB", "new")]
    s = status.first()
    assert (s.status, s.product_count, s.error) == ("success", 1, None)
    assert s.errors == ["musinsa: timeout", "kurly: Source returned an error page", "29cm: Source returned HTTP status 500"]
    assert counters.where("source = 'danawa'").first().total_link_count == 2
    doc = json.loads(outputs.crawl_documents(products, status, counters).first()["value"])
    assert (doc["query"], doc["product_count"], doc["products"][0]["source"], doc["debug"]["danawa"]["raw_image_candidate_count"]) == ("갤럭시 S25", 1, "danawa", 0)
    (c,) = e.candidate_counters(asked, pages).where("source = 'danawa'").collect()
    assert (c.raw_candidate_count, c.aggregated_candidate_count, c.normalized_candidate_count, c.image_candidates_with_identity_count, c.image_examples) == (2, 1, 1, 0, [])
    assert e.crawl(asked, pages.where("source = 'kurly'"))[2].first().status == "access_error"
    assert e.crawl(asked, pages.where("source = 'musinsa'"))[2].first().status == "render_error"
    assert e.crawl(asked, pages.limit(0))[2].first().status == "no_results"


# -- sources -----------------------------------------------------------------------------------------------


def test_file_import_and_store(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    csv = tmp_path / "p.csv"
    csv.write_text("﻿name,판매가,seller,url\nA,\"1,200원\",,https://x.example/1\n,5,s,https://x.example/2\nB,9,t,\n", encoding="utf-8")
    assert e.import_products(str(csv), "csv", source_license="L") == 2
    a, b = e.products(limit=10).orderBy("product_name").collect()
    assert (a.price, a.seller, a.product_url, a.source_license, a.currency, a.condition) == (1200.0, None, "https://x.example/1", "L", "KRW", "unknown") and b.id != a.id
    doc = tmp_path / "p.json"
    doc.write_text(json.dumps({"products": [{"title": "C", "price": 10, "link": "https://x.example/1"}, {"title": "D", "link": "https://x.example/3"}, {"title": "E"}]}), encoding="utf-8")
    first, second = e.import_saved(str(doc)), e.import_saved(str(doc))
    assert (first["read_count"], first["saved_count"]) == (3, 2) and (second["saved_count"], second["skipped_count"]) == (1, 2)
    assert e.search("CSV").count() == 2 and e.search("x_y").count() == 0
    assert {r.source_name: r.product_count for r in e.sources().collect()} == {"csv": 2, "saved_html_import": 3}
    ids = [r.id for r in e.store.products.select("id").collect()]
    assert sorted(ids) == list(range(1, 6))
    for bad in (lambda: e.products(limit=201), lambda: e.search(""), lambda: e.import_products(str(csv), "x", limit=0)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "p.txt").write_text("x")
    with pytest.raises(ValueError):
        files.file_rows(spark, str(tmp_path / "p.txt"))
    with pytest.raises(ValueError):
        e.store.add(spark.createDataFrame([("x", -1.0, "test", "s")], "product_name string, price double, platform string, data_source string"))
    assert e.store.products.count() == 5 and e.quality().first().product_count == 5


def test_collect_logs_runs(spark, tmp_path):
    row = spark.createDataFrame([("A", 1.0, "s", "https://x.example/1", "d")], "product_name string, price double, seller string, product_url string, data_source string")
    failed = spark.createDataFrame([(0, "bad", "boom")], "source_ord int, source_name string, error_message string")

    def broken(q, n):
        raise RuntimeError("down")

    e = Engine(spark, str(tmp_path), {"ok": (lambda q, n: row, "test", False, True), "part": (lambda q, n: (row, failed), "shopping_mall", True, False), "down": (broken, "test", False, True)})
    assert e.collect("ok")["status"] == "success"
    assert e.collect("part")["status"] == "partial_success" and e.collect("part")["error_message"] == "bad: boom"
    with pytest.raises(RuntimeError):
        e.collect("down")
    with pytest.raises(KeyError):
        e.collect("nowhere")
    log = [(r.source_name, r.status) for r in e.store.runs.orderBy("id").collect()]
    assert log == [("ok", "success"), ("bad", "failed"), ("part", "partial_success"), ("bad", "failed"), ("part", "partial_success"), ("down", "failed")]
    board = {r.source_name: r.product_count for r in e.sources().collect()}
    assert board == {"ok": 0, "part": 0, "down": 0, "d": 3}
    bench = {r["query"]: r.product_count for r in e.benchmark("ok", ["a", "b"]).collect()}
    assert bench == {"a": 1, "b": 1, None: 2}


def test_api_answers(spark):
    item = {"title": "", "price": {"value": "199.99"}, "shippingOptions": [{"shippingCost": {"value": "x"}}, {"shippingCost": {"value": "5.0"}}], "seller": {"username": "u"}, "itemWebUrl": "https://e.example/1",
            "condition": "Used", "categories": [{"categoryName": "a"}, {"categoryName": "b"}], "itemLocation": {"city": "Seoul", "country": "KR"}}
    r = api.ebay_products(spark.createDataFrame([(json.dumps({"itemSummaries": [item, {"categoryPath": "p"}]}),)], "json string")).orderBy("ord").collect()
    assert (r[0].product_name, r[0].price, r[0].shipping_fee, r[0].currency, r[0].category, r[0].region, r[0].condition) == ("Untitled eBay item", 199.99, 5.0, "USD", "b", "Seoul, KR", "used")
    assert (r[1].seller, r[1].category, r[1].condition, r[1].region) == ("eBay seller", "p", "unknown", None)
    xml = "<R><Products><Product><ProductName> 커피 </ProductName><SalePrice>12,900</SalePrice><Delivery>무료</Delivery></Product><Product/></Products></R>"
    p = api.elevenst_products(spark.createDataFrame([(xml,)], "xml string")).orderBy("ord").collect()
    assert (p[0].product_name, p[0].price, p[0].shipping_fee, p[0].seller) == ("커피", 12900.0, 0.0, "11st seller")
    with pytest.raises(Exception, match="API error 7: no key"):
        api.elevenst_products(spark.createDataFrame([("<R><Error><Code>7</Code><Message>no key</Message></Error></R>",)], "xml string")).collect()


def test_configs():
    good = {"name": "s", "domains": ["A.example "], "permission": {"approved": True, "note": "n"}, "selectors": {"product_card": "c", "product_name": "n", "price": "p", "product_url": "u"}}
    assert config.list_site(good).domains == ("a.example",)
    for change in ({"permission": {"approved": "yes", "note": "n"}}, {"permission": {"approved": True}}, {"selectors": {"price": "p"}}, {"domains": []}):
        with pytest.raises(ValueError):
            config.list_site(good | change)
    paged = good | {"search_url_template": "https://a.example/s?q={query}&page={page}"}
    assert config.choose_source({"sources": [paged]}).name == "s"
    for bad in ({"sources": []}, {"sources": [paged, paged | {"name": "t"}]}, {"sources": [good]}):
        with pytest.raises(ValueError):
            config.choose_source(bad)
    assert config.choose_source({"sources": [paged, paged | {"name": "t"}]}, "t").name == "t"
    assert not config.auto_source({"name": "x", "collection_method": "api"}).approved
    with pytest.raises(ValueError):
        config.auto_source(good | {"collection_method": "api"})


# -- plans -------------------------------------------------------------------------------------------------


CSS = {"product_card": ".card", "product_name": ".name", "price": ".price", "shipping_fee": ".ship", "seller": ".seller", "product_url": ".name", "image_url": "img"}


def shop_card(name, price, url, seller="Mall", image="/i.jpg"):
    return f'<div class="card"><a class="name" href="{url}">{name}</a><b class="price">{price}</b><i class="ship">배송비 3,000원</i><u class="seller">{seller}</u>{f"<img src={image}>" if image else ""}</div>'


def test_paged_collection(spark):
    source = config.SiteConfig("shop", CSS, search_url_template="https://shop.example/s?q={query}&page={page}", approved=True, permission_note="n")
    asked = collect.paged_addresses(spark, source, "a b", 4).orderBy("page").collect()
    assert asked[1].url == "https://shop.example/s?q=a+b&page=2"
    html = {
        1: shop_card("A", "49,900원", "/products/1?utm_source=x") + shop_card("B", "29,900원", "/products/2") + shop_card("C", "19,900원", "/products/3"),
        2: shop_card("A again", "49,900원", "/products/1?utm_campaign=y") + shop_card("D", "159,000원", "/products/4?color=black&utm_m=l") + shop_card("E", "9,900원", "/products/5", image=None),
        3: shop_card("D", "1원", "/products/4?color=black") + shop_card("F", "5원", "/products/6"), 4: "",
    }
    rows = [(p.page, p.url, html[p.page], "User-agent: *\nDisallow: /s?q=a+b&page=4" if p.page == 4 else None) for p in asked]
    products, pages, run = collect.collect_paged(spark.createDataFrame(rows, "page int, url string, html string, robots_txt string"), source, "a b")
    r = run.first()
    assert (r.requested_pages, r.successful_pages, r.total_extracted_count, r.duplicate_count, r.final_product_count, r.missing_image_url) == (4, 3, 8, 2, 6, 1)
    assert [(p.status, p.extracted_count, p.unique_added_count, p.duplicate_count) for p in pages.orderBy("page").collect()] == [
        ("success", 3, 3, 0), ("success", 3, 2, 1), ("success", 2, 1, 1), ("failed", 0, 0, 0),
    ]
    d = products.where("product_name = 'D'").first()
    assert d.normalized_product_url == "https://shop.example/products/4?color=black" and d.data_source == "auto_html:shop" and d.shipping_fee == 3000.0


def test_multi_source_collection(spark):
    site = lambda n, **more: config.SiteConfig(n, CSS, list_urls=(f"https://{n}.example/",), approved=True, permission_note="n", default_seller=f"{n} shop", **more)
    configs = [site("one"), site("two"), config.SiteConfig("closed", CSS), config.SiteConfig("api", {}, collection_method="api", api_collector="x", approved=True), config.SiteConfig("lost", {}, collection_method="api", api_collector="y", approved=True)]
    pages = spark.createDataFrame(
        [("one", 0, "https://one.example/", shop_card("A", "5", "https://u.example/1", seller="") + shop_card("B", "6", "https://u.example/2"), None), ("two", 0, "https://two.example/", "", "404"),
         ("closed", 0, "https://closed.example/", shop_card("X", "1", "/x"), None)],
        "source_name string, page_ord int, url string, html string, fetch_error string",
    )
    ready = spark.createDataFrame([(0, "C", 7.0, None, "https://u.example/3", "z"), (1, "B", 7.0, "q", "https://u.example/2", "z"), (2, "N", 1.0, "q", None, "z")], "ord bigint, product_name string, price double, seller string, product_url string, data_source string")
    products, failed = collect.collect_sources(spark, pages, configs, {"x": ready})
    assert [(p.product_name, p.seller, p.data_source) for p in products.collect()] == [("A", "one shop", "one"), ("B", "Mall", "one"), ("C", None, "api")]
    assert sorted((f.source_name, f.error_message) for f in failed.collect()) == [("lost", "API collector is not registered: y"), ("two", "404")]


def test_approved_list_pages(spark):
    site = config.SiteConfig("s", CSS, domains=("shop.example",), approved=True, permission_note="n")
    pages = spark.createDataFrame([(0, "https://www.shop.example/", shop_card("A", "5", "/1") + shop_card("B", "6", "/2")), (1, "https://shop.example/n", shop_card("A2", "5", "https://www.shop.example/1"))], "page_ord int, url string, html string")
    assert [p.product_name for p in collect.list_collection(pages, [site]).collect()] == ["A", "B"]
    with pytest.raises(Exception, match="no configuration"):
        collect.list_collection(spark.createDataFrame([(0, "https://other.example/", "")], "page_ord int, url string, html string"), [site]).collect()


def test_merge_of_saved_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text(saved_page(ITEMS, [("광고 1", "/ad/1", "")]), encoding="utf-8")
    other = [{"productTitle": "광고 하나", "price": "1", "mallProductUrl": "/ad/1?utm_x=1", "imageUrl": "/i"}, {"productTitle": "셋", "price": "", "imageUrl": "/j", "mallName": "다"}]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.HTM").write_text(saved_page(other), encoding="utf-8")
    (tmp_path / "c.txt").write_text("no page")
    pages = files.html_pages(spark, str(tmp_path)).persist()
    products, by_file, run = merge.merge_pages(pages)
    r = run.first()
    assert (r.file_count, r.total_extracted_count, r.duplicate_count, r.final_product_count, r.ad_count, r.organic_count, r.missing_product_url, r.missing_price) == (2, 5, 1, 4, 1, 3, 2, 1)
    assert sorted((f.extracted_count, f.ad_count) for f in by_file.collect()) == [(2, 0), (3, 1)]
    _, summary_rows = merge.saved_rows(pages)
    assert sorted((s.total_before_dedup, s.total_after_dedup, s.duplicate_count) for s in summary_rows.collect()) == [(2, 2, 0), (4, 3, 1)]
    outputs.write_result(products.select("source_file", "item_ord", "product_name", "dedupe_key"), run, ["source_file", "item_ord"], str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    text = file.read_text()
    assert [p["product_name"] for p in json.loads(text)["products"]] == ["광고 1", "일반 1", "일반 2", "셋"]
    with pytest.raises(Exception):
        files.html_pages(spark, str(tmp_path / "missing")).count()


def test_streams(spark, tmp_path):
    store = ProductStore(spark, str(tmp_path / "store"))
    schema = "product_name string, product_url string, platform string, data_source string"
    folder = str(tmp_path / "in")
    spark.createDataFrame([("A", "https://x.example/1", "test", "d"), ("B", None, "test", "d")], schema).write.parquet(folder)
    run = lambda: imports.import_stream(spark.readStream.schema(schema).parquet(folder), store, str(tmp_path / "cp")).awaitTermination(120)
    run()
    spark.createDataFrame([("A2", "https://x.example/1", "test", "d"), ("C", "https://x.example/2", "test", "d")], schema).write.mode("append").parquet(folder)
    run()
    run()
    assert sorted(r.product_name for r in store.products.collect()) == ["A", "B", "C"]
    runs = spark.createDataFrame([(1, "s", "failed", 1.0, "e", "2024-01-01 00:00:00"), (2, "s", "success", 2.0, None, "2024-01-01 00:01:00")], "id long, source_name string, status string, response_time_ms double, error_message string, started_at string")
    runs.withColumn("started_at", F.col("started_at").cast("timestamp")).write.parquet(str(tmp_path / "runs"))
    stream = imports.latest_run_stream(spark.readStream.schema(spark.read.parquet(str(tmp_path / "runs")).schema).parquet(str(tmp_path / "runs")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.data_source, r.last_status) for r in spark.table("latest").collect()] == [("s", "success")]


def test_secondhand_pages_and_reports(spark):
    html = '<a href="/product/1"><span class="line-clamp-2">폰</span><span class="text-18 font-bold">650,000</span></a>'
    rows = frames.secondhand_products(spark.createDataFrame([("p", html), ("q", None)], "path string, html string"))
    s = summary.secondhand_summary(rows.select("path", F.explode("products").alias("p")).select("path", "p.*")).first()
    assert (s.product_count, s.missing_name, s.missing_image, s.missing_region, s.missing_sale_status) == (1, 0, 1, 1, 1)
    page = "".join(f'<li class="card"><a class="nm" href="/p/{i}">물건 {c}</a><span class="pr">{i}9,900원</span></li>' for i, c in enumerate("abc"))
    cards, fields = outputs.discovery(spark.createDataFrame([(1, page)], "page_id int, html string"))
    draft = outputs.draft_config("s", "https://s.example", cards, fields)["sources"][0]
    assert draft["permission"]["approved"] is False and draft["selectors"] == {} and fields["price"][0]["matching_cards"] == 3
    assert "product_card:" in outputs.text_report("s", "u", cards, fields) and "approved: false" in outputs.draft_yaml({"sources": [draft]})
    assert outputs.file_name(" 갤럭시 S25! ") == "갤럭시_S25" and outputs.file_name("!!") == "query"


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "price double, shipping_fee double, seller string, product_url string, detail_description string")
    r = summary.summarize_products(empty).first()
    assert (r.product_count, r.seller_count, r.missing_price_rate, r.missing_detail_description_rate) == (0, 0, 0.0, None)


def test_search_is_ascii_case_insensitive_with_wildcards(spark):
    rows = spark.createDataFrame([("Ärger A_b\\c",), ("x",), (None,)], "product_name string")
    hit = lambda q: filters.search(rows, q, ("product_name",)).count()
    assert [hit("a_B"), hit("ä"), hit("b\\C"), hit("%")] == [1, 0, 1, 2]




def test_pages_find_their_configuration_by_equal_keys(spark):
    sites = [config.SiteConfig(n, {}, domains=d) for n, d in (("a", ("x.example", "b.example")), ("b", ("shop.x.example", "b.example")), ("c", ("example",)))]
    urls = ["https://shop.x.example/1", "https://X.example:8080/", "http://u:p@deep.b.example/", "https://notx.example/", "https://other.org/", "no address", None, "https://x.example/1", "https://x.example/1"]
    known = config.configured_pages(spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, i int"), config.configs_frame(spark, sites))
    assert [r.name for r in known.orderBy("i").collect()] == ["a", "a", "a", "c", None, None, None, "a", "a"]
    assert "NestedLoop" not in known._jdf.queryExecution().executedPlan().toString()


def test_a_benchmark_summary_reads_its_products_once(spark, tmp_path):
    rows = [("q", 1.0, "s"), ("q", None, "t"), (None, 2.0, "s"), ("r", 3.0, "")]
    spark.createDataFrame(rows, "query string, price double, seller string").write.parquet(str(tmp_path / "p"))
    products = spark.read.parquet(str(tmp_path / "p")).withColumns({c: F.lit(None).cast("string") for c in ("shipping_fee", "product_url", "detail_description")})
    found = summary.benchmark_summary(products)
    assert sorted(((r.query or "", r.product_count, r.seller_count) for r in found.collect())) == [("", 1, 1), ("", 4, 2), ("q", 2, 2), ("r", 1, 0)]
    assert summary.benchmark_summary(products)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [r.product_count for r in summary.benchmark_summary(products.limit(0)).collect()] == [0]


def test_the_latest_run_is_kept_as_state_over_restarts(spark, tmp_path):
    shape = "id long, source_name string, status string, response_time_ms double, error_message string, started_at timestamp"
    spark.conf.set(*imports.STATE_STORE)

    def run(rows):
        at = lambda t: datetime(2024, 1, 1, 0, t)
        spark.createDataFrame([(i, s, st, ms, e, at(t)) for i, s, st, ms, e, t in rows], shape).write.mode("append").parquet(str(tmp_path / "runs"))
        stream = imports.latest_run_updates(spark.readStream.schema(shape).parquet(str(tmp_path / "runs")))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
        return sorted((r.data_source, r.last_id, r.last_status, r.last_error_message) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    try:
        first = [("a", 2, "success", None), ("b", 3, "failed", "e")]
        assert run([(1, "a", "failed", 1.0, "x", 5), (2, "a", "success", None, None, 5), (3, "b", "failed", 2.0, "e", 1)]) == first
        # A late run changes nothing; an equal start goes by id.
        assert run([(9, "a", "failed", 1.0, "late", 4), (4, "b", "success", 1.0, None, 1), (5, "c", "success", 1.0, None, 9)]) == sorted([*first, ("b", 4, "success", None), ("c", 5, "success", None)])
    finally:
        spark.conf.unset(imports.STATE_STORE[0])


def test_the_best_name_follows_from_mergeable_states(spark):
    """Groups with and without fragments that lack a direct name, before and behind the first that has one."""
    rng = random.Random(3)
    parts = ["갤럭시 S25", "울트라 256GB", "삼성전자", "New phone", "블랙", "12,345원", "ab", "자급제", "케이스 / 필름 / 충전기"]
    text = lambda: rng.choice([None, " ", rng.choice(parts), " / ".join(rng.sample(parts, rng.randrange(1, 5)))])
    rows = [{"product_name": text() if rng.random() < 0.6 else "닫기", "description": text(), "seller": text(), "product_url": f"{PCODE}{rng.randrange(60)}", "confidence": 1.0} for _ in range(500)]
    want = {}
    for url in {r["product_url"] for r in rows}:
        said = [(o, i, t) for o, r in enumerate(rows) if r["product_url"] == url for i, t in enumerate((r["product_name"], r["description"], r["seller"])) if t and t.strip()]
        told = [(o, i, N.best(" ".join(t.split()), "갤럭시 S25")) for o, i, t in said]
        told = [x for x in told if x[2][1][2] is not None]
        first = min((o for o, i, _ in told if i == 0), default=None)
        best = max(((*(b[2] if i and first is not None and o >= first else b[1])[:1], i == 0, -o, i < 2, *(b[2] if i and first is not None and o >= first else b[1])[1:]) for o, i, b in told), default=None)
        if best is not None:
            want[url] = best[-1][:160]
    source = reduce.with_identity(candidates(spark, rows, query="갤럭시 S25")).withColumn("_group", F.col("identity"))
    got = reduce.aggregate_group(source, ["request_id", "source", "_group"])
    assert {r.product_url: r.product_name for r in got.collect()} == want and len(want) > 20


def test_a_group_of_very_many_fragments_is_summed_up_where_they_are(spark):
    one = candidates(spark, [{"product_name": "갤럭시 S25 256GB", "description": "블랙 / 자급제", "product_url": f"{PCODE}1", "price": 1}])
    rows = reduce.with_identity(one.drop("ord").crossJoin(spark.range(200_000).select(F.col("id").alias("ord"))), True).withColumn("_group", F.col("identity"))
    named = reduce.aggregate_group(rows, ["request_id", "source", "_group"]).select("product_name", "fragment_count", "condition")
    assert [tuple(r) for r in named.collect()] == [("갤럭시 S25 256GB", 200_000, "new")]
    plan = reduce.aggregate_group(rows, ["request_id", "source", "_group"]).select("product_url", "condition", "price")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "collect_list" not in plan
    shown = reduce.aggregate_group(rows, ["request_id", "source", "_group"]).select("product_name")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in shown and shown.count("partial_collect_list") == 1


def test_prices_are_found_without_collapsing_white_space_first(spark):
    from pyspark.sql import functions as F

    from haggle.functions import price as P

    rows = [("a  12,345 \t 원 b", 12345), ("7\x1c원", 7), ("1　원 2,000", 1), ("가격\t제안 5원", None), ("가격  제안 5원", None), ("제안 가격 5원", 5), ("1,234 x", 1234), (" 12 ", None), ("", None), (None, None)]
    told = spark.createDataFrame(rows, "t string, want long")
    assert [r for r in told.withColumn("got", P.parse_price(F.col("t"))).collect() if r.got != r.want] == []
    assert told.where("t = ' 12 '").select(P.parse_price(F.col("t"), structured=True)).first()[0] == 12
    # White space is collapsed for texts that may hold a marker of two words, not for every look at a text.
    assert told.select(P.parse_price(F.col("t")).alias("p"))._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 1
