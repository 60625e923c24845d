"""Extractors for five marketplaces' result pages.

Each takes (html, scripts, limit) and gives candidates of confidence 10 with the site's raw facts."""

from __future__ import annotations

import json
import re
from html import unescape
from urllib.parse import parse_qs, urljoin, urlsplit

from .dom import Element, squash, tree
from .generic import candidate, parse_json, walk

# Markers, labels and patterns of the sites' pages.
IMAGE_KEYS = ("src", "data-src", "data-original", "data-lazy-src")
WON = re.compile(r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*원")
PERCENT = re.compile(r"([0-9]+)\s*%")
KURLY_LINK = re.compile(r"(?:^|/)goods/([0-9]+)(?:[/?#]|$)")
KURLY_NO_NAMES = ("담기", "장바구니", "샛별배송", "첫구매", "리뷰", "Kurly Only", "쿠폰", "품절")
KURLY_NO_IMAGES = ("collection-image", "sticker", "logo", "banner", "badge", "icon", "sprite", "placeholder", "loading")
LOTTE_LINK = re.compile(r"/p/product/(LO[^/?#]+)", re.I)
LOTTE_CARD, LOTTE_IMAGE = "c-product-list__item", "contents.lotteon.com/itemimage/"
LOTTE_NO_NAMES = ("좋아요", "무료배송", "스펙 정보", "리뷰", "평점", "카드 할인", "AD")
LOTTE_NO_IMAGES = ("logo", "banner", "icon", "badge", "event", "placeholder", "loading")
NUMBER = re.compile(r"(?<![0-9])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?![0-9])")
CM_LINKS = (re.compile(r"product\.29cm\.co\.kr/catalog/([0-9]+)", re.I), re.compile(r"/catalog/([0-9]+)(?:[/?#]|$)", re.I))
CM_IMAGE = "img.29cm.co.kr/item/"
CM_PRICE = re.compile(r"(?<![%0-9])([0-9]{1,3}(?:,[0-9]{3})+)(?!\s*%)")
CM_NO_NAMES = ("무료배송", "리뷰", "좋아요", "쿠폰", "담기", "랭킹", "할인")
CM_NO_IMAGES = ("logo", "icon", "banner", "badge", "placeholder", "sprite")
KURLY_NO_NAME = re.compile(r"[0-9]+\s*%|[0-9,]+|\+?[0-9]+%\s*쿠폰")
KURLY_REVIEWS = re.compile(r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)")
KURLY_CLASSES = {
    "name": ("product-name", "goods-name", "name"), "description": ("desc", "description", "subtitle", "sub-title"), "badges": ("badge", "label", "tag", "delivery", "shipping"),
    "reviews": ("review-count", "review"), "sale": ("sales-price",), "discounted": ("discount-price",), "original": ("dimmed-price",), "rate": ("discount-rate",),
}
LOTTE_NO_NAME = re.compile(r"[0-9,]+\s*원?|[0-9]+%|[0-9.]+")
LOTTE_PERCENT = re.compile(r"([0-9]{1,2})\s*%")
LOTTE_RATINGS = (re.compile(r"([0-5](?:\.[0-9])?)\s*(?:고객평점|평점)"), re.compile(r"(?:고객평점|평점)\s*([0-5](?:\.[0-9])?)"))
LOTTE_REVIEWS = re.compile(r"([0-9,]+)\s*(?:리뷰|건)")
LOTTE_CLASSES = {
    "title": "c-product-title", "price": "c-product-price", "original": "c-product-price__real", "final": "c-product-price__final", "rate": "c-product-price__sale",
    "seller": ("seller", "store", "mall", "shop"), "brand": ("brand",),
}
CM_NO_NAME = re.compile(r"[0-9]+\s*%|[0-9.]+|[0-9,]+")
CM_CLASSES = ("product-name", "item-name", "goods-name", "name", "title")
ELEVENST_WANTED = {"id", "title", "finalprc", "selprc", "discountprice", "linkurl", "imageurl", "productid", "productno", "productname", "price"}
ELEVENST_IDS = ("id", "productNo", "productId", "prdNo", "goodsNo", "itemId")
ELEVENST_TITLES = ("title", "productName", "prdName", "goodsName", "itemName", "name")
ELEVENST_PRICES = ("finalPrc", "salePrice", "price", "finalPrice", "displayPrice", "selPrc")
ELEVENST_URLS = ("linkUrl", "productUrl", "prdUrl", "goodsUrl", "itemUrl", "url", "link")
ELEVENST_IMAGES = ("imageUrl", "imgUrl", "productImage", "thumbnail", "thumb")
ELEVENST_SELLERS = ("seller", "sellerName", "storeName", "mallName")
MUSINSA_PRICES = ("finalPrice", "couponPrice", "price", "normalPrice")
MUSINSA_RAW = ("goodsNo", "brand", "brandName", "normalPrice", "price", "couponPrice", "finalPrice", "finalDiscount", "saleRate", "couponSaleRate", "isSoldOut", "isAd")


def _made(raw: dict, **values) -> dict:
    return candidate(condition="new", confidence=10.0, raw=json.dumps(raw, ensure_ascii=False), **values)


def _texts(card: Element, *parts: str) -> list[str]:
    """Distinct texts of the elements whose class has one of the parts."""
    return list(dict.fromkeys(t for e in card.below() if e.class_has(*parts) and (t := e.card_text())))


def _source(e: Element) -> str | None:
    for key in IMAGE_KEYS:
        if squash(e.attrs.get(key)):
            return squash(e.attrs[key])
    listed = squash(e.attrs.get("srcset") or e.attrs.get("data-srcset"))
    return listed.split(",")[0].strip().split(" ")[0] if listed else None


def _images(scope: Element):
    return (e for e in scope.below() if e.tag in ("img", "source"))


def _full(value: str | None, base: str) -> str | None:
    return value if not value or value.startswith(("http://", "https://")) else urljoin(base, value)


def _first(pattern: re.Pattern, texts: list[str]) -> int | None:
    return next((int(re.sub("[^0-9]", "", m[1])) for t in texts if (m := pattern.search(t))), None)


def _unique(found, limit: int) -> list[dict]:
    """The first of each product number, up to the limit; ``found`` gives (number, candidate)."""
    kept: dict[str, dict] = {}
    for number, made in found:
        if made["product_name"] and made["price"] and made["price"] > 0 and made["product_url"] and made["image_url"]:
            kept.setdefault(number, made)
            if len(kept) >= limit:
                break
    return list(kept.values())


# -- kurly ----------------------------------------------------------------------------------------------


def kurly(html: str, _scripts: list[dict], limit: int) -> list[dict]:
    base = "https://www.kurly.com"

    def no_name(t: str) -> bool:
        return bool(WON.search(t)) or bool(KURLY_NO_NAME.fullmatch(t)) or any(m in t for m in KURLY_NO_NAMES)

    def price(texts: list[str]) -> int | None:
        return next((p for t in texts if (m := WON.search(t)) and (p := int(m[1].replace(",", ""))) > 0), None)

    def fits(t: str | None, least: int, most: int) -> str | None:
        return t if t and least <= len(t) <= most and not no_name(t) else None

    def label(e: Element) -> str | None:
        return next((squash(e.attrs[k]) for k in ("alt", "aria-label", "title") if squash(e.attrs.get(k))), None)

    def shows_product(e: Element) -> bool:
        image = _source(e)
        seen = f"{image} {e.attrs.get('class') or ''} {label(e) or ''}".lower()
        return bool(image) and not image.startswith("data:") and not any(m in seen for m in KURLY_NO_IMAGES)

    def describe(card: Element, name: str | None) -> str | None:
        good = lambda t: fits(t, 4, 200) if t != name else None
        named = next(filter(None, map(good, _texts(card, *KURLY_CLASSES["description"]))), None)
        if named:
            return named
        texts = list(dict.fromkeys(t for e in card.below() if (t := e.card_text())))
        after = texts[texts.index(name) + 1 :] if name in texts else []
        return next(filter(None, map(good, after)), None)

    def cards():
        seen = set()
        for a in (e for e in tree(html).below() if e.tag == "a"):
            href = unescape(a.attrs.get("href") or "")
            m = KURLY_LINK.search(href)
            # A number is done with its first link, usable or not.
            if not m or m[1] in seen:
                continue
            seen.add(m[1])
            pictures = [e for e in _images(a) if shows_product(e)]
            name = next(filter(None, (fits(t, 2, 160) for t in [*_texts(a, *KURLY_CLASSES["name"]), *map(label, pictures)])), None)
            image = _source(pictures[0]) if pictures else None
            cost = price(_texts(a, *KURLY_CLASSES["sale"])) or price(_texts(a, *KURLY_CLASSES["discounted"]))
            badges = [t for t in _texts(a, *KURLY_CLASSES["badges"]) if len(t) <= 80][:10]
            raw = {
                "product_id": m[1], "original_price": price(_texts(a, *KURLY_CLASSES["original"])), "discount_rate": _first(PERCENT, _texts(a, *KURLY_CLASSES["rate"])),
                "review_count": _first(KURLY_REVIEWS, _texts(a, *KURLY_CLASSES["reviews"])), "badges": badges,
            }
            yield m[1], _made(
                raw, product_name=name, price=cost, price_text=None if cost is None else str(cost), product_url=urljoin(base, href),
                image_url=image and urljoin(base, image), description=describe(a, name),
            )

    return _unique(cards(), limit)


# -- lotteon --------------------------------------------------------------------------------------------


def lotteon(html: str, _scripts: list[dict], limit: int) -> list[dict]:
    base = "https://www.lotteon.com"

    def ui(t: str) -> bool:
        return any(m in t for m in LOTTE_NO_NAMES)

    def clean(t: str | None) -> str | None:
        return t if t and 2 <= len(t) <= 200 and not ui(t) and not LOTTE_NO_NAME.fullmatch(t) else None

    def last_number(t: str | None) -> int | None:
        found = NUMBER.findall(LOTTE_PERCENT.sub(" ", t or ""))
        return int(found[-1].replace(",", "")) if found else None

    def within(box: Element, part: str, read):
        return next((v for e in box.below() if e.class_has(part) and (v := read(e.card_text())) is not None), None)

    def named(card: Element, *parts: str) -> str | None:
        return next((t for e in card.below() if e.class_has(*parts) and (t := e.card_text()) and 1 < len(t) <= 80 and not ui(t)), None)

    def percent(t: str | None) -> int | None:
        m = LOTTE_PERCENT.search(t or "")
        return int(m[1]) if m else None

    def cards():
        for card in (e for e in tree(html).below() if e.tag == "li" and LOTTE_CARD in e.classes):
            links = [(e, m[1]) for e in card.below() if e.tag == "a" and e.attrs.get("href") and (m := LOTTE_LINK.search(unescape(e.attrs["href"])))]
            if not links:
                continue
            number, address = links[0][1], urljoin(base, links[0][0].attrs["href"])
            titles = [e.card_text() for e in card.below() if e.class_has(LOTTE_CLASSES["title"])] + [e.card_text() for e, _ in links]
            box = next((e for e in card.below() if e.class_has(LOTTE_CLASSES["price"])), None)
            cost = original = rate = said = None
            if box is not None:
                said = box.card_text()
                original = within(box, LOTTE_CLASSES["original"], last_number)
                cost = within(box, LOTTE_CLASSES["final"], last_number)
                cost = last_number(said) if cost is None else cost
                rate = within(box, LOTTE_CLASSES["rate"], percent)
            image = next(
                (i for e in _images(card) if (i := _full(_source(e), base)) and LOTTE_IMAGE in i
                 and not any(m in f"{i} {e.attrs.get('class') or ''} {e.attrs.get('alt') or ''}".lower() for m in LOTTE_NO_IMAGES)),
                None,
            )
            all_text = card.card_text() or ""
            score = next((m for p in LOTTE_RATINGS if (m := p.search(all_text))), None)
            reviews = LOTTE_REVIEWS.search(all_text)
            brand = named(card, *LOTTE_CLASSES["brand"])
            raw = {
                "product_id": number, "sitm_no": (parse_qs(urlsplit(unescape(address)).query).get("sitmNo") or [None])[0], "brand": brand,
                "original_price": original, "discount_rate": rate, "rating": float(score[1]) if score else None,
                "review_count": int(reviews[1].replace(",", "")) if reviews and reviews[1].strip(",") else None, "source_product_url": address,
            }
            yield number, _made(
                raw, product_name=next(filter(None, map(clean, titles)), None), price=cost, price_text=said,
                seller=named(card, *LOTTE_CLASSES["seller"]) or brand, product_url=f"{base}/p/product/{number}", image_url=image,
            )

    return _unique(cards(), limit)


# -- 29cm -----------------------------------------------------------------------------------------------


def cm29(html: str, _scripts: list[dict], limit: int) -> list[dict]:
    base = "https://www.29cm.co.kr"

    def number_of(e: Element) -> str | None:
        href = unescape(e.attrs.get("href") or "")
        return next((m[1] for p in CM_LINKS if (m := p.search(href))), None) if e.tag == "a" else None

    def item_image(e: Element) -> str | None:
        image = _full(_source(e), base)
        return image if image and CM_IMAGE in image else None

    def no_name(t: str) -> bool:
        return bool(CM_PRICE.search(t)) or bool(CM_NO_NAME.fullmatch(t)) or any(m in t for m in CM_NO_NAMES)

    def clean(value) -> str | None:
        t = squash(value)
        return t if t and 2 <= len(t) <= 200 and not no_name(t) else None

    def container(link: Element) -> Element:
        """The list item around, else the outermost element that still is one short card."""
        best = link
        for e in (link, *link.above()):
            if e.tag == "li":
                return e
            inner = list(e.below())
            if len(e.card_text() or "") < 2000 and any(i.tag in ("img", "source") and item_image(i) for i in inner) and any(map(number_of, inner)):
                best = e
        return best

    def cards():
        for image in _images(tree(html)):
            address = item_image(image)
            if not address or any(m in f"{address} {image.attrs.get('class') or ''} {image.attrs.get('alt') or ''}".lower() for m in CM_NO_IMAGES):
                continue
            link = next((e for e in image.above() if number_of(e)), None)
            if link is None:
                continue
            number, card = number_of(link), container(link)
            own = list(dict.fromkeys(t for e in card.below() if (t := e.own_text())))
            titled = list(dict.fromkeys(t for e in card.below() if e.class_has(*CM_CLASSES) and (t := e.own_text() or e.card_text())))
            name = next(filter(None, map(clean, [*titled, *(image.attrs.get(k) for k in ("alt", "aria-label", "title"))])), None)
            costs = [p for t in own for m in CM_PRICE.findall(PERCENT.sub(" ", t)) if (p := int(m.replace(",", ""))) >= 1000]
            cost = costs[-1] if costs else None
            brand = next((t for t in own if t != name and not no_name(t) and len(t) <= 60), None)
            yield number, _made(
                {"product_id": number, "brand": brand, "discount_rate": _first(PERCENT, own)}, product_name=name, price=cost,
                price_text=None if cost is None else str(cost), seller=brand, product_url=f"https://product.29cm.co.kr/catalog/{number}", image_url=address,
            )

    return _unique(cards(), limit)


# -- elevenst -------------------------------------------------------------------------------------------


def elevenst(html: str, _scripts: list[dict], limit: int) -> list[dict]:
    base = "https://www.11st.co.kr"
    payload = parse_json(html.strip())
    if payload is None:
        inner = re.search(r"<pre[^>]*>(.*?)</pre>", html, re.I | re.S)
        payload = parse_json(inner[1]) if inner else None

    def value(item: dict, keys):
        spelled = {str(k).lower(): v for k, v in item.items()}
        return next((spelled[k.lower()] for k in keys if spelled.get(k.lower()) not in (None, "")), None)

    def amount(v) -> int | None:
        if isinstance(v, (int, float)):
            return int(v) if v >= 0 else None
        digits = re.sub("[^0-9]", "", str(v)) if v not in (None, "") else ""
        return int(digits) if digits else None

    def price(item: dict) -> int | None:
        return next((p for k in ELEVENST_PRICES if (p := amount(value(item, (k,))))), None)

    def points(item: dict) -> int:
        return len({str(k).lower() for k in item} & ELEVENST_WANTED) + bool(squash(value(item, ELEVENST_TITLES))) + (price(item) is not None)

    def link(v) -> str | None:
        v = squash(v)
        return None if not v else f"https:{v}" if v.startswith("//") else urljoin(base, v)

    arrays = []
    for node in walk(payload):
        items = [x for x in node if isinstance(x, dict)] if isinstance(node, list) else []
        total = sum(map(points, items[:10]))
        if items and total >= 5:
            arrays.append((total, items))
    # The likeliest product list first; equal ones as they stand.
    arrays.sort(key=lambda a: (-a[0], -len(a[1])))

    def cards():
        for _, items in arrays:
            for item in items:
                number = squash(value(item, ELEVENST_IDS))
                if points(item) < 3 or not number:
                    continue
                cost = price(item)
                raw = {"product_id": number} | {k: squash(value(item, (k,))) for k in ("finalPrc", "selPrc", "discountPrice", "linkUrl")}
                yield number, _made(
                    raw, product_name=squash(value(item, ELEVENST_TITLES)), price=cost, price_text=None if cost is None else str(cost),
                    seller=squash(value(item, ELEVENST_SELLERS)), product_url=link(value(item, ELEVENST_URLS)), image_url=link(value(item, ELEVENST_IMAGES)),
                )

    return _unique(cards(), limit)


# -- musinsa --------------------------------------------------------------------------------------------


def next_data(scripts: list[dict]) -> dict:
    """The page state that a script named __NEXT_DATA__ holds."""
    script = next((s for s in scripts if s["id"] == "__NEXT_DATA__"), None)
    payload = parse_json(script["content"]) if script and script["content"] else None
    return payload if isinstance(payload, dict) else {}


def at_path(value, *keys):
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def musinsa(_html: str, scripts: list[dict], limit: int) -> list[dict]:
    listed = lambda v: v if isinstance(v, list) else []

    def positive(v) -> int | None:
        if isinstance(v, bool):
            return None
        if isinstance(v, str):
            v = v.replace(",", "").strip()
            v = int(v) if v.isdecimal() else 0
        return int(v) if isinstance(v, (int, float)) and int(v) > 0 else None

    out = []
    for q in listed(at_path(next_data(scripts), "props", "pageProps", "dehydratedState", "queries")):
        for page in listed(at_path(q, "state", "data", "pages")):
            for item in listed(at_path(page, "items")):
                if not isinstance(item, dict) or not (item.get("goodsName") and item.get("goodsLinkUrl") and item.get("thumbnail")):
                    continue
                cost = next((p for k in MUSINSA_PRICES if (p := positive(item.get(k))) is not None), None)
                if cost is not None and len(out) < limit:
                    seller = next((str(item[k]).strip() for k in ("brandName", "brand") if item.get(k) is not None and str(item[k]).strip()), None)
                    out.append(
                        _made(
                            {k: item.get(k) for k in MUSINSA_RAW}, product_name=str(item["goodsName"]), price=cost, price_text=str(cost), seller=seller,
                            product_url=str(item["goodsLinkUrl"]), image_url=str(item["thumbnail"]),
                        )
                    )
    return out


SITES = {"29cm": cm29, "elevenst": elevenst, "kurly": kurly, "lotteon": lotteon, "musinsa": musinsa}
