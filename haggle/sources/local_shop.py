"""A shop on this machine for trying out collections: three list pages of eight cards, two of them repeats."""

from __future__ import annotations

from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

#: Page by page: numbers of the goods shown; a number that comes again is the same product.
SHELVES = ((1, 2, 3), (1, 4, 5), (3, 6))
SELECTORS = {
    "product_card": "article.goods", "product_name": "a.title", "price": "span.cost", "shipping_fee": "span.fee", "seller": "em.shop", "product_url": "a.title", "image_url": "img",
}


def card(number: int, page: int) -> str:
    """One product; a repeat differs in what its link tracks."""
    fee = "무료배송" if number % 2 == 0 else f"배송비 {number},000원"
    return (
        f'<article class="goods"><a class="title" href="/goods/{number}?utm_source=page{page}">Goods {number}</a><span class="cost">{number}9,900원</span>'
        f'<span class="fee">{fee}</span><em class="shop">Shop {number % 3}</em><img src="/pictures/{number}.jpg"></article>'
    )


def list_page(query: str, page: int) -> str:
    shown = SHELVES[page - 1] if 1 <= page <= len(SHELVES) else ()
    return f"<html><head><title>{escape(query)}</title></head><body>{''.join(card(n, page) for n in shown)}</body></html>"


class _Handler(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        address = urlsplit(self.path)
        asked = {k: v[0] for k, v in parse_qs(address.query).items()}
        if address.path == "/robots.txt":
            self._answer(200, "text/plain", "User-agent: *\nAllow: /list\nDisallow: /private\n")
        elif address.path == "/list":
            self._answer(200, "text/html", list_page(asked.get("q", ""), int(asked.get("page", "1"))))
        else:
            self._answer(404, "text/plain", "not found")

    def _answer(self, status: int, kind: str, text: str):
        body = text.encode()
        self.send_response(status)
        self.send_header("Content-Type", f"{kind}; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def shop_server(port: int = 0) -> ThreadingHTTPServer:
    """A server on the local address, to be run with ``serve_forever``; port 0 takes a free one."""
    return ThreadingHTTPServer(("127.0.0.1", port), _Handler)
