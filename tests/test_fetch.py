"""Fetching, the local shop, debug files and the HTTP surface."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit
from urllib.request import Request, urlopen

import pytest

from haggle import serve
from haggle.engine import Engine
from haggle.plans import collect, outputs
from haggle.sources import config, connectors, fetch
from haggle.sources.local_shop import SELECTORS, shop_server


def running(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_address[1]}"


def test_local_shop_is_fetched_and_collected(spark):
    server = shop_server()
    try:
        base = running(server)
        source = config.paged_source({"name": "local", "selectors": SELECTORS, "search_url_template": base + "/list?q={query}&page={page}", "permission": {"approved": True, "note": "own"}})
        started = time.monotonic()
        pages = fetch.fetch_pages(collect.paged_addresses(spark, source, "goods", 3), delay=0.2).cache()
        assert [(r.http_status, r.title, r.fetch_error) for r in pages.collect()] == [(200, "goods", None)] * 3
        assert time.monotonic() - started > 0.4
        products, by_page, run = collect.collect_paged(pages.select("page", "url", "html", "fetch_error"), source, "goods")
        r = run.first()
        assert (r.total_extracted_count, r.duplicate_count, r.final_product_count) == (8, 2, 6)
        assert sorted(p.price for p in products.collect()) == [n * 10000 + 9900 for n in range(1, 7)]
        lost = spark.createDataFrame([(base + "/nowhere",), (None,)], "url string")
        assert sorted(r.fetch_error for r in fetch.fetch_pages(lost, delay=0).collect()) == ["HTTPError: HTTP Error 404: Not Found", "ValueError: no address"]
    finally:
        server.shutdown()


def test_getters_are_chosen_by_row(spark, tmp_path):
    rows = spark.createDataFrame([("a", "https://x.example/1", True), ("b", "https://x.example/2", False), ("b", "https://y.example/3", None)], "source string, url string, rendered boolean")
    got = fetch.fetch_pages(rows, get=lambda u: (200, u, "got", "<p>" + u), render=lambda u: (None, u, "shown", "<b>\n" + u), delay=0).cache()
    assert sorted((r.url[-1], r.title, r.http_status) for r in got.collect()) == [("1", "shown", None), ("2", "got", 200), ("3", "got", 200)]
    outputs.dump_pages(got, str(tmp_path / "debug"))
    files = sorted(p for p in (tmp_path / "debug").rglob("part-*"))
    assert [p.parent.name for p in files] == ["source=a", "source=b", "source=b"]
    assert files[0].read_text() == "<b>\nhttps://x.example/1\n"


def test_http_surface(spark, tmp_path):
    row = spark.createDataFrame([("A", 1.0, "s", "https://x.example/1", "d")], "product_name string, price double, seller string, product_url string, data_source string")

    def down(q, n):
        raise RuntimeError("down")

    engine = Engine(spark, str(tmp_path), {"ok": (lambda q, n: row, "test", False, True), "down": (down, "test", False, True)})
    ask = lambda method, path: serve.answer(engine, method, path)
    assert ask("GET", "/")[1]["collectors"] == ["down", "ok"]
    assert ask("POST", "/collect/ok?limit=5")[1]["product_count"] == 1
    assert [p["product_name"] for p in ask("GET", "/products?limit=5")[1]] == ["A"] == [p["product_name"] for p in ask("GET", "/search?q=a")[1]]
    assert [ask(*r)[0] for r in (("GET", "/products?limit=0"), ("GET", "/search?q="), ("POST", "/collect/none"), ("POST", "/collect/down"), ("GET", "/collect/ok"), ("POST", "/import/products?file_path=x.txt&data_source=d"))] == [422, 422, 404, 502, 404, 422]
    assert len(ask("POST", "/collect/ok/benchmark?queries=a&queries=b")[1]) == 3
    server = serve.server(engine, 0)
    try:
        base = running(server)
        with urlopen(Request(base + "/sources")) as r:
            assert {s["source_name"] for s in json.loads(r.read())} == {"ok", "down", "d"}
    finally:
        server.shutdown()


class Market(BaseHTTPRequestHandler):
    """Both APIs on this machine; what they were asked stays in ``asked``."""

    asked: list = []

    def say(self, text, status=200):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(text.encode())

    def do_POST(self):
        form = self.rfile.read(int(self.headers["Content-Length"])).decode()
        self.asked.append(("token", self.headers["Authorization"], parse_qs(form)["grant_type"]))
        self.say(json.dumps({"access_token": "t1"} if self.headers["Authorization"] == "Basic aWQ6c2VjcmV0" else {}))

    def do_GET(self):
        at, asked = urlsplit(self.path), parse_qs(urlsplit(self.path).query)
        self.asked.append((at.path, self.headers["Authorization"], asked))
        if at.path == "/ebay":
            self.say(json.dumps({"itemSummaries": [{"title": f"{asked['q'][0]} {i}", "price": {"value": str(i)}} for i in range(3)]}))
        elif asked.get("key") == ["k"]:
            self.say("<R><Product><ProductName>" + asked["keyword"][0] + "</ProductName><ProductPrice>5원</ProductPrice></Product></R>")
        elif asked.get("key") == ["old"]:
            self.say("<R><Error><Code>9</Code><Message>expired</Message></Error></R>")
        else:
            self.say("no", 403)

    def log_message(self, *args):
        pass


def test_api_collectors_ask_and_collect(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Market)
    try:
        base = running(server)
        ebay = connectors.ebay_collector(spark, "id", "secret", "EBAY_DE", base + "/ebay", base + "/token")
        made = {k: (connectors.elevenst_collector(spark, k, base + "/xml"), "shopping_mall", True, True) for k in ("k", "old", "bad")}
        engine = Engine(spark, str(tmp_path), {"ebay": (ebay, "shopping_mall", True, True), **made})
        assert engine.collect("ebay", "a b&c", 150)["product_count"] == 3
        assert Market.asked[:1] == [("token", "Basic aWQ6c2VjcmV0", ["client_credentials"])]
        assert {(p, auth, q["q"][0], q["limit"][0]) for p, auth, q in Market.asked[1:]} == {("/ebay", "Bearer t1", "a b&c", "150")}
        # What is asked is asked once, though the products are checked and stored.
        assert len(Market.asked) == 2
        assert engine.collect("k", "갤럭시 +", 50)["product_count"] == 1
        assert Market.asked[-1][2] == {"key": ["k"], "apiCode": ["ProductSearch"], "keyword": ["갤럭시 +"], "pageNum": ["1"], "pageSize": ["50"]}
        for name, message in (("old", "API error 9: expired"), ("bad", "HTTP Error 403")):
            with pytest.raises(RuntimeError, match=message):
                engine.collect(name, "q")
        assert sorted(r.product_name for r in engine.store.products.collect()) == ["a b&c 0", "a b&c 1", "a b&c 2", "갤럭시 +"]
        with pytest.raises(RuntimeError):
            connectors.client_token("id", "wrong", base + "/token")
        for bad in (lambda: connectors.client_token("", "x"), lambda: engine.collect("ebay"), lambda: connectors.elevenst_collector(spark, None)("q", 5)):
            with pytest.raises(RuntimeError):
                bad()
    finally:
        server.shutdown()
    assert [c[3] for c in connectors.api_collectors(spark, {"ELEVENST_API_KEY": "x"}).values()] == [False, True]
    assert connectors.ebay_requests(spark.createDataFrame([("q",)], "query string"), 500).first().url.endswith("?q=q&limit=200")
