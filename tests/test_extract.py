"""Extractors on literal pages."""

import json

import pytest

from haggle.extract import dom, generic, lists, saved, sites

DANAWA = ("prod.danawa.com/info/", "pcode=")


def blocks(html, hints=(), query=None):
    return generic.dom(generic.events(html), hints, query)


# -- tree and selectors ---------------------------------------------------------------------------------


def test_tree_closes_up_to_the_start_and_ignores_stray_ends():
    root = dom.tree("<div><p>one<b>two</div></i><span>three</span>", whole=True)
    assert [e.tag for e in root.children] == ["div", "span"]
    assert root.text() == "one two three"
    deep = dom.tree("<div>" * 5000 + "x" + "</div>" * 5000)
    assert sum(1 for _ in deep.below()) == 5000 and deep.card_text() == "x"


@pytest.mark.parametrize(
    "css, ids",
    [
        ("li", "ab"), (".x", "ac"), ("li.x", "a"), ("ul .x", "a"), ("ul > li", "ab"), ("#c", "c"), ("[data-k]", "b"), ("[data-k='v 1']", "b"),
        ('a[href^="/p/"]', "c"), ("div a.x", "c"), ("li, a", "abc"), (".a\\:b", "b"), ("span", ""),
    ],
)
def test_selectors(css, ids):
    root = dom.tree('<ul><li id=a class="x y"></li><li id=b class="a:b" data-k="v 1"></li></ul><div><a id=c class=x href="/p/1">t</a></div>')
    assert "".join(e.attrs["id"] for e in dom.Selector(css).all(root)) == ids


def test_unsupported_selector():
    with pytest.raises(ValueError):
        dom.Selector("li:hover")


# -- generic ----------------------------------------------------------------------------------------------


def test_scripts_and_json_ld():
    html = """<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Product"], "name": "Phone", "image": ["/a.jpg"],
      "brand": {"name": "Acme"}, "offers": [{"price": 0, "lowPrice": "650,000원", "url": "/product/1"}]}, {"@type": "Person"}]}</script>
      <script type="application/ld+json">{broken</script><script type="APPLICATION/LD+JSON">[{"type": "product", "name": 7, "price": 12.9}]</script>"""
    found = generic.json_ld(generic.scripts(generic.events(html)))
    assert [(c["product_name"], c["price"], c["seller"], c["product_url"], c["image_url"]) for c in found] == [
        ("Phone", 650000, "Acme", "/product/1", "/a.jpg"), ("7", 12, None, None, None),
    ]


def test_embedded_json_is_walked_into_matches():
    html = """<script>window.__X__ = {"title": "Shop", "url": "/", "list": [{"productName": "A", "price": "1,000원", "seller": {"nickname": "n"}, "image": {"src": "/i"}},
      {"name": "no price or link"}]};</script><script>var y = {"name": "a", "price": 1}</script>"""
    found = generic.embedded(generic.scripts(generic.events(html)))
    assert [(c["product_name"], c["price"], c["seller"], c["image_url"]) for c in found] == [("Shop", None, None, None), ("A", 1000, "n", "/i")]
    assert len(generic.embedded(generic.scripts(generic.events(html)), limit=1)) == 1


def test_link_block_with_title_and_price_in_one_text():
    (c,) = blocks('<a href="/product/2">아이폰15 블루 256GB 급처 400,000원 36분 전</a>')
    assert (c["product_name"], c["price_text"], c["product_url"]) == ("아이폰15 블루 256GB 급처", "400,000원", "/product/2")


def test_price_outside_the_link_and_lazy_images():
    html = """<ul><li><a href="https://prod.danawa.com/info/?pcode=1"><img src="data:image/gif;base64,AA" data-src="/one.jpg" alt="갤럭시 하나"></a><b>1,077,870원</b></li>
      <li><a href="https://prod.danawa.com/info/?pcode=2"><img srcset="/two.jpg 1x, /big.jpg 2x" alt="갤럭시 둘"></a><b>1,177,870원</b></li></ul>"""
    found = blocks(html, DANAWA)
    assert [(c["product_name"], c["image_url"]) for c in found][:2] == [("갤럭시 하나", "/one.jpg"), ("갤럭시 둘", "/two.jpg")]
    # Hints count for links, but element blocks look for common product paths only.
    assert blocks('<div><a href="/catalog/9">물건</a><b>9,900원</b></div>', ("/catalog/",)) == []


def test_prices_are_no_names():
    assert blocks('<li><a href="https://prod.danawa.com/info/?pcode=1">1,473,160원</a></li>', DANAWA) == []
    assert blocks('<a href="#">출시가: 1,698,400원</a>', DANAWA) == []


def test_item_card():
    html = """<li id="productItem7"><a href="/info/?pcode=7&amp;k=x"><img src="//x/noData/img/noImg_160.gif" data-src="/real.jpg" alt="폰 256GB"></a>
      <p class="prod_name"><a href="/info/?pcode=7">제조사 <b>폰</b> 울트라 256GB</a></p><ul><li><a href="/info/?pcode=7"><strong>1,473,100</strong>원</a></li></ul></li>"""
    card = generic.item_cards(generic.events(html))[0]
    assert "제조사 폰 울트라 256GB" in card.text and card.images == ["/real.jpg"]
    best = blocks(html, DANAWA, "폰 울트라")[0]
    assert (best["product_name"], best["price_text"], best["image_url"]) == ("제조사 폰 울트라 256GB", "1,473,100 원", "/real.jpg")


def test_void_end_tags_count_in_blocks():
    (block,) = generic.link_blocks(generic.events('<a href="/item/1">one<br>two<p>three</p></a><a>no address</a>'))
    assert block.text == ["one", "two", "three"]


def test_page_counters():
    _, stats = generic.extract('<title>t</title><a href="/product/1">x</a><a href="/about">y</a><script>1</script>', None)
    assert (stats["total_link_count"], stats["product_like_link_count"], stats["script_count"]) == (2, 1, 1)


# -- sites ------------------------------------------------------------------------------------------------


def site(name, html, limit=100):
    return sites.SITES[name](html, generic.scripts(generic.events(html)), limit)


def kurly_card(number, name="사과 A", price="16,900원", image="https://img/x/apple.jpg"):
    return f"""<a href="/goods/{number}?x=1"><img class="sticker" src="https://img/sticker.png"><img src="{image}" alt="{name}">
      <span class="product-name">{name}</span><p class="product-desc">거친 생김새의 과일</p><span class="dimmed-price">24,900원</span>
      <i class="discount-rate">32%</i><span class="sales-price">{price}</span><span class="review-count">999+</span><em class="badge">한정</em></a>"""


def test_kurly():
    found = site("kurly", kurly_card(1) + kurly_card(2, price="") + kurly_card(2) + kurly_card(3, "사과 C", "9,900원") + kurly_card(1, "other"))
    assert [(c["product_name"], c["price"], c["product_url"]) for c in found] == [
        ("사과 A", 16900, "https://www.kurly.com/goods/1?x=1"), ("사과 C", 9900, "https://www.kurly.com/goods/3?x=1"),
    ]
    raw = json.loads(found[0]["raw"])
    assert (raw["original_price"], raw["discount_rate"], raw["review_count"], raw["badges"]) == (24900, 32, 999, ["한정"])
    assert (found[0]["description"], found[0]["image_url"]) == ("거친 생김새의 과일", "https://img/x/apple.jpg")
    assert site("kurly", kurly_card(4, image="")) == [] and len(site("kurly", kurly_card(1) + kurly_card(3), limit=1)) == 1


def lotte_card(number, price="429,990 최종가", name="폰 256GB", body=""):
    return f"""<li class="c-product-list__item"><a href="/p/product/{number}?sitmNo={number}_1&mall_no=1"><img src="//contents.lotteon.com/itemimage/{number}.jpg"></a>
      <div class="c-product-title">{name}</div><div class="c-product-price"><s class="c-product-price__real">440,900 정상가</s>
      <i class="c-product-price__sale">2% 할인율</i><b class="c-product-price__final">{price}</b></div><p>4.5 고객평점 1,203 리뷰</p>{body}</li>"""


def test_lotteon():
    found = site("lotteon", lotte_card("LO1") + lotte_card("LO1", name="twin") + lotte_card("LO2", "100", "싼 것", '<em class="brand-name">제조</em>') + lotte_card("XX3"))
    assert [(c["product_name"], c["price"], c["seller"], c["product_url"]) for c in found] == [
        ("폰 256GB", 429990, None, "https://www.lotteon.com/p/product/LO1"), ("싼 것", 100, "제조", "https://www.lotteon.com/p/product/LO2"),
    ]
    raw = json.loads(found[0]["raw"])
    assert (raw["sitm_no"], raw["original_price"], raw["discount_rate"], raw["rating"], raw["review_count"]) == ("LO1_1", 440900, 2, 4.5, 1203)
    assert found[0]["image_url"] == "https://contents.lotteon.com/itemimage/LO1.jpg"


def cm_card(number, name="신발 A", price="139,000", image="https://img.29cm.co.kr/item/1.jpg"):
    return f"""<li><a href="https://product.29cm.co.kr/catalog/{number}?k=1"><img src="https://img.29cm.co.kr/cms/banner.jpg"><img src="{image}" alt="{name}"></a>
      <div class="brand">나이키</div><div class="name">{name}</div><div>{price}</div><div>5 리뷰 999 좋아요 123</div></li>"""


def test_29cm():
    found = site("29cm", cm_card(1) + cm_card(1, "twin") + cm_card(2, "신발 B", "30% 132,300") + cm_card(3, price="") + cm_card(4, image="https://img.29cm.co.kr/cms/x.jpg"))
    assert [(c["product_name"], c["price"], c["seller"], c["product_url"]) for c in found] == [
        ("신발 A", 139000, "나이키", "https://product.29cm.co.kr/catalog/1"), ("신발 B", 132300, "나이키", "https://product.29cm.co.kr/catalog/2"),
    ]
    assert json.loads(found[1]["raw"])["discount_rate"] == 30


def test_elevenst():
    item = lambda i, **more: {"id": i, "title": f"폰 {i}", "finalPrc": "429,990", "selPrc": "440,900", "linkUrl": f"//m.11st.co.kr/{i}", "imageUrl": f"//cdn/{i}.jpg"} | more
    html = json.dumps({"data": [{"items": []}, {"items": [item("1"), item("1", title="twin"), item("2", finalPrc="0"), item("3", finalPrc="", selPrc=""), item("4", imageUrl="")]}]})
    for text in (html, f"<html><pre class=x>{html}</pre></html>"):
        found = site("elevenst", text)
        assert [(c["product_name"], c["price"], c["product_url"]) for c in found] == [("폰 1", 429990, "https://m.11st.co.kr/1"), ("폰 2", 440900, "https://m.11st.co.kr/2")]
    assert site("elevenst", "not json") == []


def test_musinsa():
    item = {"goodsNo": 1, "goodsName": "셔츠", "goodsLinkUrl": "https://www.musinsa.com/products/1", "thumbnail": "/t.jpg", "finalPrice": True, "couponPrice": 0, "price": "29,000", "brandName": " 상표 "}
    state = {"props": {"pageProps": {"dehydratedState": {"queries": [{"state": {"data": {"pages": [{"items": [item, {"goodsName": "x"}, None]}]}}}, None]}}}}
    (c,) = site("musinsa", f'<script id="__NEXT_DATA__">{json.dumps(state)}</script>')
    assert (c["product_name"], c["price"], c["seller"]) == ("셔츠", 29000, "상표")
    assert site("musinsa", '<script id="__NEXT_DATA__">[]</script>') == []


# -- lists and saved pages --------------------------------------------------------------------------------


def test_product_page_tags():
    meta = lists.page_meta('<meta property="og:title" content=" "><meta name="twitter:title" content="Name"><meta itemprop="price" content="12,900">배송비 2,500 원<h1>H</h1>')
    assert (meta["product_name"], meta["price"], meta["shipping_fee"]) == ("Name", 12900.0, 2500.0)
    assert lists.page_meta("<h1>A <b>b</b></h1>무료배송")["product_name"] == "A b"


def test_list_cards():
    card = lambda n, p, u: f'<article class="card"><h2>{n}</h2><b>{p}</b><a href="{u}">go</a><i>Free ship</i></article>'
    html = card("A", "129,000원", "/a?x=1") + card("A2", "1원", "/a?x=1") + card("", "5", "/b") + card("C", "no", "/c") + card("D", "89,500", "d")
    css = {"product_card": "article.card", "product_name": "h2", "price": "b", "product_url": "a", "shipping_fee": "i"}
    found = lists.listed(html, "https://shop.example/list/", css, {}, "Shop")
    assert [(r["product_name"], r["price"], r["product_url"], r["shipping_fee"], r["seller"]) for r in found] == [
        ("A", 129000.0, "https://shop.example/a?x=1", 0.0, "Shop"), ("D", 89500.0, "https://shop.example/list/d", 0.0, "Shop"),
    ]
    assert len(lists.listed(html, "https://shop.example/", css, {}, "Shop", limit=1)) == 1
    assert lists.listed(html, "https://shop.example/", css, {}) == []


def saved_page(items, ads=(), query="물건 하나"):
    state = {"props": {"pageProps": {"searchParam": {"query": "", "origQuery": query}, "list": [{"item": i} for i in items]}}}
    cards = "".join(f'<div class="adProduct_item__T7utB"><a class="adProduct_link__hNwpz" href="{u}">{t}</a>{more}</div>' for t, u, more in ads)
    return f'{cards}<script id="__NEXT_DATA__" type="application/json">{json.dumps(state, ensure_ascii=False)}</script>'


ITEMS = [
    {"productTitle": "광고 1", "price": "69900", "listPrice": "109000", "dlvryFee": "4000", "mallName": "가", "mallProductUrl": "/ad/1", "imageUrl": "https://i/1.jpg"},
    {"productTitle": "일반 1", "price": "129000", "lowMallList": [{"name": ""}, {"name": "나"}], "crUrlMore": "/catalog/1", "imageUrl": "//i/2.jpg"},
    {"productTitle": " 일반 1 ", "price": "1", "crUrl": "/x", "imageUrl": "/3.jpg"},
    {"productName": "일반 2", "price": "89000", "imageUrl": "/4.jpg"},
    {"productTitle": "no image"},
]


def test_saved_page_products():
    html = saved_page(ITEMS, [("광고 1", "/ad/1", "")])
    products, raw = saved.all_products(html)
    assert raw == 4 and [(p["product_name"], p["product_type"], p["seller"], p["product_url"] and p["product_url"].rsplit(".com")[1]) for p in products] == [
        ("광고 1", "ad", "가", "/ad/1"), ("일반 1", "organic", "나", "/catalog/1"), ("일반 2", "organic", None, None),
    ]
    assert products[0]["source_url"].endswith("query=%EB%AC%BC%EA%B1%B4%20%ED%95%98%EB%82%98")
    assert products[1]["image_url"] == "https://i/2.jpg"
    assert len(saved.all_products(html, limit=2)[0]) == 2


def test_saved_page_ads():
    more = '<span class="price_num__Y66T7">0원</span><i class="price_delivery_fee__8n1e5">무료</i><b class="adProduct_mall__grJaU"> 몰 </b>'
    ads = saved.ad_products(saved_page(ITEMS, [("광고 1", "/ad/1", more), ("모르는 것", "/ad/2", ""), ("", "/ad/3", "")]), "https://shop.example/s")
    assert [(a["product_name"], a["price"], a["shipping_fee"], a["seller"], a["product_url"]) for a in ads] == [
        ("광고 1", 69900.0, 0.0, "몰", "https://shop.example/ad/1"), ("모르는 것", None, None, None, "https://shop.example/ad/2"),
    ]


def test_secondhand():
    card = lambda href, price: f'<a href="{href}"><img src="/i.jpg"><span class="line-clamp-2">중고 폰</span><span class="font-bold text-18">{price}</span><span>판매완료</span></a>'
    found = saved.secondhand(card("/product/1", "가격없음") + card("/product/1", "650,000") + card("/product/1", "1") + card("/product/x", "5"))
    assert [(r["product_id"], r["price"], r["sale_status"]) for r in found] == [("1", 650000, "판매완료")]


def test_selector_discovery():
    card = lambda i, seller: f'<section class="card big" data-k="p"><a class="nm" href="/p/{i}">물건 {chr(65 + i)}</a><span class="pr">{i}9,900원</span>{seller}<img src="/{i}.jpg"></section>'
    cards, hits = saved.discover(card(1, '<em class="mall">가게</em>') + card(2, "") + card(3, '<em class="mall">가게</em>'))
    top = {c["selector"]: c["match_count"] for c in cards}
    assert top["[data-k='p']"] == top[".card"] == top["section.card"] == 3
    assert sum(1 for f, s, _, v in hits if (f, s) == ("price", ".pr") and v) == 3
    assert {v for f, s, _, v in hits if (f, s) == ("seller", ".mall")} == {"가게"}
    assert saved.discover("") == ([], [])
