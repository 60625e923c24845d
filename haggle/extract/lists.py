"""Product lists read with a site's selectors, and the meta tags of product pages."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from .dom import Element, Selector, tree

# Where a product page says what it sells, in order.
META = {
    "product_name": (("property", "og:title"), ("name", "twitter:title"), ("itemprop", "name")),
    "price": (("property", "product:price:amount"), ("property", "og:price:amount"), ("itemprop", "price")),
    "seller": (("name", "seller"), ("itemprop", "seller"), ("itemprop", "brand")),
    "detail_description": (("property", "og:description"), ("name", "description"), ("itemprop", "description")),
    "image_url": (("property", "og:image"), ("name", "twitter:image"), ("itemprop", "image")),
}
FIELDS = ("product_name", "price", "shipping_fee", "seller", "detail_description", "product_url", "image_url")


def number(value) -> float | None:
    """All but digits and points deleted, then read; None if that is no number."""
    digits = re.sub(r"[^0-9.]", "", "" if value is None else str(value))
    try:
        return float(digits) if digits else None
    except ValueError:
        return None


def field_fee(value: str | None) -> float | None:
    if value and ("무료" in value or "free" in value.lower()):
        return 0.0
    return number(value)


def page_fee(text: str) -> float | None:
    if "무료배송" in text or "배송비 무료" in text:
        return 0.0
    found = re.search(r"배송비\s*([0-9,]+)\s*원", text)
    return number(found[1]) if found else None


def listed(html: str, url: str, selectors: dict, attributes: dict, seller: str | None = None, limit: int = 50) -> list[dict]:
    """The complete cards of a list page (name, price, seller and link), each link once."""
    compiled = {k: Selector(v) for k, v in selectors.items()}

    def read(card: Element, field: str, default: str | None = None) -> str | None:
        found = compiled[field].first(card) if field in compiled else None
        if found is None:
            return None
        attribute = attributes.get(field) or default
        value = found.attrs.get(attribute) if attribute else found.text()
        return (value or "").strip() or None

    out: dict[str, dict] = {}
    for card in compiled["product_card"].all(tree(html, whole=True)):
        row = {f: read(card, f) for f in ("product_name", "price", "shipping_fee", "seller", "detail_description")}
        row["price"], row["shipping_fee"] = number(row["price"]), field_fee(row["shipping_fee"])
        row["seller"] = row["seller"] or seller
        for f, default in (("product_url", "href"), ("image_url", "src")):
            value = read(card, f, default)
            row[f] = urljoin(url, value) if value else None
        if row["product_name"] and row["price"] is not None and row["seller"] and row["product_url"]:
            out.setdefault(row["product_url"], row)
            if len(out) >= limit:
                break
    return list(out.values())


def page_meta(html: str) -> dict:
    """Name, price, shipping fee, seller, description and image as a product page's tags give them."""
    root = tree(html, whole=True)
    elements = list(root.below())

    def meta(field: str) -> str | None:
        for key, value in META[field]:
            # Only the first tag of a kind is asked.
            e = next((e for e in elements if e.attrs.get(key) == value), None)
            content = e and (e.attrs.get("content") or e.attrs.get("href") or e.attrs.get("src"))
            if content and content.strip():
                return content.strip()
        return None

    heading = next((e for e in elements if e.tag == "h1"), None)
    row = {f: meta(f) for f in META}
    row["product_name"] = row["product_name"] or (heading.text() or None if heading is not None else None)
    row["price"] = number(row["price"])
    row["shipping_fee"] = page_fee(root.text())
    return row
