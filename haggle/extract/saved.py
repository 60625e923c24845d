"""Saved result pages: advertised and organic products, second-hand lists, and selector discovery."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin

from .dom import Element, Selector, squash, tree
from .generic import events, scripts, walk
from .lists import number
from .sites import at_path, next_data

# The selectors of the saved shop pages, their address, and sale states.
DEFAULT_URL = "https://search.shopping.naver.com/search/all?query={query}"
AD = {
    "card": Selector(".adProduct_item__T7utB"),
    "name": Selector(".adProduct_link__hNwpz"),
    "price": Selector(".price_num__Y66T7"),
    "original": Selector(".price_org_price__2W2CX"),
    "fee": Selector(".price_delivery_fee__8n1e5"),
    "seller": Selector(".adProduct_mall__grJaU"),
}
LINK_FIELDS = ("mallProductUrl", "crUrl", "crUrlMore", "mallPcUrl")
SALE_STATES = ("판매완료", "예약중", "판매중")
SELLER_WORDS = ("seller", "mall", "store", "shop", "brand")
PRICE_LIKE = re.compile(r"\d[\d,.\s]*")


def _text(e: Element | None) -> str | None:
    return squash(e.text()) if e is not None else None


def _title(item: dict):
    return item.get("productTitle") or item.get("productName")


def page_items(html: str) -> list[dict]:
    """Product objects of the page state in reading order, a wrapped ``item`` before its wrapper; each object once."""
    found: dict[int, dict] = {}
    for node in walk(next_data(scripts(events(html, whole=True)))):
        for item in (node.get("item"), node) if isinstance(node, dict) else ():
            if isinstance(item, dict) and isinstance(_title(item), str) and item.get("imageUrl"):
                found.setdefault(id(item), item)
    return list(found.values())


def resolved_url(html: str, url: str) -> str:
    """The default address with the query that the page state names; any other address as it is."""
    if url != DEFAULT_URL:
        return url
    search = at_path(next_data(scripts(events(html, whole=True))), "props", "pageProps", "searchParam")
    asked = next((search[k] for k in ("query", "origQuery", "adQuery") if isinstance(search, dict) and search.get(k)), None)
    return DEFAULT_URL.format(query=quote(asked.strip())) if isinstance(asked, str) and asked.strip() else url


def _row(**values) -> dict:
    return dict.fromkeys(("product_name", "product_type", "price", "original_price", "shipping_fee", "seller", "product_url", "image_url", "source_url")) | values


def ad_products(html: str, url: str = DEFAULT_URL, limit: int | None = None) -> list[dict]:
    """Products of the advertised cards, completed from the page state by title (its last object)."""
    url, root = resolved_url(html, url), tree(html, whole=True)
    by_title = {str(_title(i)): i for i in page_items(html) if _title(i)}
    out = []
    for card in AD["card"].all(root)[:limit]:
        part = {k: AD[k].first(card) for k in ("name", "price", "original", "fee", "seller")}
        title = _text(part["name"])
        href = (part["name"].attrs.get("href") or "") if title else ""
        if not title or not href:
            continue
        item = by_title.get(title, {})
        fee = _text(part["fee"])
        out.append(
            _row(
                product_name=title,
                product_type="ad",
                # A shown price of 0 gives way to the state's price.
                price=number(_text(part["price"])) or number(item.get("price")),
                original_price=number(_text(part["original"])) or number(item.get("listPrice")),
                shipping_fee=(0.0 if "무료" in fee else number(fee)) if fee else number(item.get("dlvryFee")),
                seller=_text(part["seller"]) or item.get("mallName"),
                product_url=urljoin(url, href.strip()),
                image_url=urljoin(url, str(item["imageUrl"])) if item.get("imageUrl") else None,
                source_url=url,
            )
        )
    return out


def all_products(html: str, url: str = DEFAULT_URL, limit: int | None = None) -> tuple[list[dict], int]:
    """Products of the page state, each title once, and how many objects there were."""
    url, root = resolved_url(html, url), tree(html, whole=True)
    advertised = {_text(AD["name"].first(card)) for card in AD["card"].all(root)}
    items = page_items(html)
    out: dict[str, dict] = {}
    for item in items:
        title = _title(item).strip()
        if not title or title in out:
            continue
        mall = item.get("mallName")
        seller = mall.strip() if isinstance(mall, str) and mall.strip() else None
        if seller is None and isinstance(item.get("lowMallList"), list):
            seller = next((str(m["name"]).strip() for m in item["lowMallList"] if isinstance(m, dict) and m.get("name")), None)
        link = next((item[f].strip() for f in LINK_FIELDS if isinstance(item.get(f), str) and item[f].strip()), None)
        out[title] = _row(
            product_name=title,
            product_type="ad" if title in advertised else "organic",
            price=number(item.get("price")),
            original_price=number(item.get("listPrice")),
            shipping_fee=number(item.get("dlvryFee")),
            seller=seller,
            product_url=urljoin(url, link) if link else None,
            image_url=urljoin(url, str(item["imageUrl"])),
            source_url=url,
        )
        if limit is not None and len(out) >= limit:
            break
    return list(out.values()), len(items)


def secondhand(html: str) -> list[dict]:
    """Second-hand cards: links to a product number with a title and an all-digit price."""
    title, price, image, spans = (Selector(s) for s in ("span.line-clamp-2", "span.text-18.font-bold", "img[src]", "span"))
    out: dict[str, dict] = {}
    for a in Selector('a[href^="/product/"]').all(tree(html, whole=True)):
        found = re.fullmatch(r"/product/(\d+)", a.attrs["href"])
        if not found or found[1] in out:
            continue
        name, cost, picture = title.first(a), price.first(a), image.first(a)
        digits = cost.text().replace(",", "") if cost is not None else ""
        if name is None or not digits.isdigit():
            continue
        texts = [s.text() for s in spans.all(a)]
        out[found[1]] = {
            "product_id": found[1],
            "product_name": name.text(),
            "price": int(digits),
            "product_url": "https://web.joongna.com" + a.attrs["href"],
            "image_url": picture.attrs.get("src") if picture is not None else None,
            "sale_status": next((t for t in texts if t in SALE_STATES), None),
        }
    return list(out.values())


# -- selector discovery -----------------------------------------------------------------------------------


def _price_like(text: str) -> bool:
    return bool(PRICE_LIKE.search(text.replace(" ", "")))


def selectors_of(e: Element) -> list[str]:
    """Selectors a reviewer could use for the element: data attributes, three classes, tag and class, tag."""
    plain = lambda c: re.sub(r"([^A-Za-z0-9_-])", r"\\\1", c)
    quoted = lambda v: v.replace("\\", "\\\\").replace("'", "\\'")
    found = [f"[{k}='{quoted(v.strip())}']" for k, v in sorted(e.attrs.items()) if k.startswith("data-") and v and v.strip()]
    found += [f".{plain(c)}" for c in e.classes[:3]]
    if e.classes:
        found.append(f"{e.tag}.{plain(e.classes[0])}")
    return list(dict.fromkeys([*found, e.tag]))


def card_selectors(root: Element, top: int = 8) -> list[dict]:
    """Selectors that match two blocks or more and whose first twenty hold links, images or prices."""
    matched: dict[str, list[Element]] = {}
    for e in root.below():
        for s in selectors_of(e):
            matched.setdefault(s, []).append(e)
    blocks = {s for e in root.below() if e.tag in ("div", "li", "section", "article") for s in selectors_of(e)}

    def points(e: Element) -> int:
        tags = list(e.below())
        return any(t.tag == "a" and "href" in t.attrs for t in tags) + any(t.tag in ("img", "source") for t in tags) + _price_like(e.text())

    ranked = []
    for s in (s for s in matched if s in blocks):
        found = _all(root, s, matched)
        score = sum(map(points, found[:20]))
        if len(found) >= 2 and score > 0:
            samples = [t[:120] for e in found[:3] if (t := _text(e))]
            ranked.append((score, {"selector": s, "match_count": len(found), "matching_cards": len(found), "sample_values": samples}))
    ranked.sort(key=lambda r: (-r[0], -r[1]["matching_cards"]))
    return [r for _, r in ranked[:top]]


def _all(root: Element, selector: str, matched: dict[str, list[Element]]) -> list[Element]:
    # Classes past an element's third are matched too, though they name no selector of their own.
    return Selector(selector).all(root) if selector.startswith(".") or "." in selector else matched[selector]


def field_hits(cards: list[Element]) -> list[tuple[str, str, int, str | None]]:
    """(field, selector, card, value) for everything in the cards that looks like a field, and
    without a value where a field's selector matches in a card of which it gave none."""
    found = []
    for i, card in enumerate(cards):
        for e in card.below():
            text = _text(e) or ""
            named = " ".join([e.tag, *(f"{k} {v}" for k, v in e.attrs.items())]).lower()
            values = {}
            if e.tag in ("a", "span", "strong", "em", "div") and text:
                if 2 <= len(text) <= 140 and not _price_like(text) and re.search(r"[^\W\d_]", text):
                    values["product_name"] = text
                if not _price_like(text) and len(text) <= 80 and any(w in named for w in SELLER_WORDS):
                    values["seller"] = text
                if e.tag != "a" and _price_like(text):
                    values["price"] = text
            href = (e.attrs.get("href") or "").strip()
            if e.tag == "a" and href and not href.startswith("#"):
                values["product_url"] = href
            picture = e.attrs.get("src") or e.attrs.get("data-src") or e.attrs.get("srcset")
            if e.tag in ("img", "source") and picture:
                values["image_url"] = picture.strip()
            found += [(field, s, i, v) for field, v in values.items() for s in selectors_of(e)]
    named = {(f, s) for f, s, _, _ in found}
    given = {(f, s, i) for f, s, i, _ in found}
    for i, card in enumerate(cards):
        present = {s for s in {s for _, s in named} if Selector(s).first(card) is not None}
        found += [(f, s, i, None) for f, s in sorted(named) if s in present and (f, s, i) not in given]
    return found


def discover(html: str, top: int = 8) -> tuple[list[dict], list[tuple[str, str, int, str | None]]]:
    """Card selectors of a page, and the field hits inside the cards of the best one."""
    root = tree(html, whole=True)
    cards = card_selectors(root, top)
    return cards, field_hits(Selector(cards[0]["selector"]).all(root)) if cards else []
