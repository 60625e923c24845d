"""What queries give on rows that the smallest tables do not hold, and what their plans do at size."""

import os

import duckdb
import pytest

from haggle import queries

SF = "/root/testdata/sf0.001"


def linked(folder, *own):
    """A folder with the smallest tables but those of its own."""
    for f in os.listdir(SF):
        if f.split(".")[0] not in own:
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
    return str(folder)


def same(spark, con, sf, name):
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["page_meta", "css_list_parse", "page_links"])
def test_references_cut_off_before_their_end_are_text(spark, tmp_path, name):
    texts = ["a&amp;&amp", "b &lt; c&l", "&amp;lt; d&", "e &quot;f&quot", "&amp;#x27; g&#x2", "h&#39", "i&amp;amp"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    for i, t in enumerate(texts):
        html = f"<html><head><script>var n={i};</script></head><body><nav><ul><li><a href=\"/p?a=1&amp;b={i}&amp\">x</a></li></ul></nav><article><h1>{t}</h1></article></body></html>"
        con.execute("INSERT INTO pages VALUES (?, 'https://x.example/', ?)", [i, html])
    con.execute(f"COPY pages TO '{linked(tmp_path, 'pages')}/pages.parquet'")
    same(spark, con, str(tmp_path), name)


def test_items_are_dealt_out_before_they_are_parsed(spark):
    """A table of parts is one small file; its pages are parsed on every core."""
    assert queries.QUERIES["extractor_order"](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_task_holds_the_rows_of_few_pages_together():
    """Pages of a batch are given on in parts: what is found in them is much larger than they are."""
    import pyarrow as pa

    from haggle.extract import frames

    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    parts = list(frames.in_parts(iter([batch, batch.slice(0, 0), batch])))
    assert max(p.num_rows for p in parts) <= 128
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch, batch])


def test_pages_of_a_search_are_parsed_once_and_in_many_tasks(spark, monkeypatch):
    from haggle.plans import collect

    seen = []

    def listed(pages, limit):
        made = list_products(pages, limit)
        seen.append(made.rdd.getNumPartitions())
        return made

    list_products = collect.list_products
    monkeypatch.setattr(collect, "list_products", listed)
    by_page = queries.QUERIES["paged_pages"](spark, SF)
    assert seen == [max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))]
    plan = by_page._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and plan.count("WindowGroupLimit") > 0


@pytest.mark.parametrize("name", ["fixture_search", "import_files", "saved_import"])
def test_json_files_hold_many_rows(spark, monkeypatch, tmp_path, name):
    """2,000 parts make two files, not a hundred, and the same rows."""
    import glob

    from haggle import queries_feeds, queries_results

    for module in (queries_feeds, queries_results):
        monkeypatch.setattr(module, "shared_folder", lambda spark, kind: f"file://{tmp_path}/{kind}")
    con = duckdb.connect()
    con.sql("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.01/part.parquet'")
    same(spark, con, "/root/testdata/sf0.01", name)
    folder = {"fixture_search": "fixture", "import_files": "import/parts.json", "saved_import": "saved/in.json"}[name]
    assert len(glob.glob(f"{tmp_path}/{folder}/*.txt")) == 2


def test_addresses_without_a_host_are_fetched_in_many_lanes(spark, tmp_path):
    from haggle.sources import page_source

    log = page_source.AddressLog(spark, f"file://{tmp_path}/log")
    log.append(spark.range(200).selectExpr("concat('file:///x/', id) AS url"))
    log.append(spark.range(9).selectExpr("concat('http://one.example/', id) AS url"))
    first, second = (page_source.lanes(log.path, [n]) for n in (1, 2))
    assert 32 < len(first) <= page_source.HOSTLESS and len(second) == 1


def test_an_xml_node_is_parsed_once(spark):
    """Not once for each of its tags: a node's texts come from one pass and are those that XPath gives."""
    from pyspark.sql import functions as F

    from haggle.sources import api

    plan = queries.QUERIES["elevenst_feed"](spark, SF)._jdf.queryExecution().toString()
    assert "xpath_string(node" not in plan.lower() and "/Product/" not in plan
    nodes = [
        "<ProductName> a &amp; b &#x41; <![CDATA[<c>]]> <!-- no --> <i>in<j>ner</j></i>\r\nz</ProductName><Seller/><Seller>second</Seller>",
        "<n:X>p</n:X><SalePrice>\t5 </SalePrice><x><Seller>deep</Seller></x>", "<ProductName>상품  </ProductName>t<Delivery></Delivery>u", "", "<ImageUrl>a<b/>c<b/>d</ImageUrl>",
    ]
    made = spark.createDataFrame([(f"<Product>{n}</Product>",) for n in nodes], "node string")
    for row in made.select("node", *(F.xpath_string("node", F.lit(f"/Product/{t}")).alias(t) for t in api.TAGS)).collect():
        said = api.node_texts(row["node"])
        assert [said.get(t, "") for t in api.TAGS] == [row[t] for t in api.TAGS]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize("name", ["aggregate_identity", "aggregate_best_name", "eligible_products", "crawl_topk"])
def test_texts_are_searched_before_the_reduction(spark, whole_plans, name):
    """An aggregate works out its inputs several times: it is given columns, and no pattern."""
    reductions = [line for line in plan_of(queries.QUERIES[name](spark, SF)).splitlines() if "Aggregate(" in line and "partial_min" in line]
    assert reductions and not any(p in line for line in reductions for p in ("RLIKE", "regexp", "forall", "Contains("))


def test_texts_without_odd_white_space_are_as_the_pattern_makes_them(spark):
    from pyspark.sql import functions as F

    from haggle.functions import text as T
    from haggle.functions import urls as U

    texts = ["a b", " a", "a  b ", "\ta", "a　b", "a b", "상품 / 이름", "상품 이름", "x\x1cy", "", "  ", None, "\U0001f600 z", "a\nb", "é e", "미개봉 REFURBISHED", "Renewed", "S등급", "리퍼", "RENEWEK"]
    made = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.nullif(F.trim(F.regexp_replace("t", T.WS + "+", " ")), F.lit(""))
    marks = [F.col("t").rlike(p) for p in ("중고|S등급|A등급|최상급", "(?i)리퍼|refurbished|renewed", "새상품|미개봉|신품|자급제")]
    for row in made.select(T.squash(F.col("t")).alias("a"), plain.alias("b"), F.array(*T.condition_marks(F.col("t"))).alias("c"), F.array(*marks).alias("d")).collect():
        assert row["a"] == row["b"] and row["c"] == row["d"]
    urls = ["http://h", "http://h/", "http://h//", "http:///", "http:////a/", "http://h/a/b//", "http://h/a;p", "http://h;/a/", "http://h/a;p/b/", "http://h?x=1", "http://h/a/?id=3&b", "http://h/a#id=3", "1http://h/", "h/a/", "", None, "http://h/a&id=7/", "HTTP://h/é/\n/"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    url, ids = F.col("u"), F.array(F.lit("id"))
    path = F.rtrim(F.regexp_replace(U.part(url, 3), ";[^/]*$", ""), F.lit("/"))
    address = F.when(url.rlike(U.PARTS), F.concat(U.part(url, 1), F.lit("://"), U.part(url, 2), path)).otherwise(url)
    long = F.coalesce(F.concat(F.lit("s:id:"), F.nullif(F.regexp_extract(url, "[?&]id=([^&#]+)", 1), F.lit(""))), F.concat(F.lit("s:url:"), address))
    assert [tuple(r) for r in frame.select(U.identity(url, F.lit("s"), ids), long).collect() if r[0] != r[1]] == []


def test_fragments_joined_by_part_are_numbered_where_they_are(spark, whole_plans):
    from haggle.plans import views

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(views.fragments(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(dealt) == 2 and all("_partkey" in line for line in dealt)


@pytest.mark.parametrize("name", ["dedupe_products_by_price", "dedupe_first_seen"])
def test_rows_are_described_after_most_of_them_are_gone(spark, whole_plans, name):
    """What follows from other columns is neither sorted nor sent: platform, fee, and each value once."""
    plan = plan_of(queries.QUERIES[name](spark, SF))
    last = plan.index("Exchange hashpartitioning(" + ("source" if name == "dedupe_products_by_price" else "product_url"))
    assert "group_buy" in plan[:last] and "group_buy" not in plan[last:] and "100000" not in plan[last:]
    if name == "dedupe_products_by_price":
        assert "_link" not in plan


def test_rows_without_a_link_keep_how_it_was_said(spark):
    from haggle.plans.crawl import dedupe_products

    rows = [("", "A", 1), (None, "a", 2), (None, "B", 3), ("", "b", 4), ("-", "C", 5), ("-", "D", 6), ("a", "E", 7)]
    made = spark.createDataFrame([("r", "s", u, n, 5, 0, 0.0, o) for u, n, o in rows], "request_id string, source string, product_url string, product_name string, price int, source_ord int, confidence double, ord int")
    got = {r["ord"]: r["product_url"] for r in dedupe_products(made).collect()}
    assert got == {1: "", 3: None, 5: "-"}


def test_pages_are_files_that_tasks_put_in_place(spark, monkeypatch, tmp_path):
    """One file for a page and nothing beside it: no folder, no checksum, no second listing by name."""
    from haggle import queries_results

    monkeypatch.setattr(queries_results, "shared_folder", lambda spark, kind: f"file://{tmp_path}/{kind}")
    rows = [(i, "https://x.example/", h) for i, h in ((0, "a\nb"), (1, ""), (2, "c\r\n"), (3, '"상품"\x01\x02'), (4, None), (2999, "d" * 5000), (3000, " e "), (-1, "f"), (-3001, "g\n"))]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    (tmp_path / "in").mkdir()
    con.execute(f"COPY pages TO '{tmp_path}/in/pages.parquet'")
    same(spark, con, str(tmp_path / "in"), "page_files")
    files = sorted(str(p.relative_to(tmp_path / "saved")) for p in (tmp_path / "saved").rglob("*") if p.is_file())
    assert files == sorted(["htm0/0/0.htm", "htm1/0/1.HTM", "txt/0/2.txt", "htm0/0/3.htm", "htm1/0/4.HTM", "txt/2/2999.txt", "htm0/3/3000.htm", "htm0/-1/-1.htm", "htm0/-4/-3001.htm"])
    assert (tmp_path / "saved/htm0/0/3.htm").read_bytes() == '"상품"\x01\x02\n'.encode()


def test_saved_pages_are_listed_once_and_read_by_few_tasks(spark, tmp_path):
    from haggle.sources import files

    names = [f"{i % 7}/[{i}] %20.{e}" for i, e in enumerate(["htm", "HTML"] * 150)] + ["0/a.txt", "1/_b.htm"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # less than opening a file counts
    try:
        pages = files.html_pages(spark, str(tmp_path), f"{tmp_path}/3", f"file://{tmp_path}/4/../4")
        assert pages.rdd.getNumPartitions() == files.PARTS_OF_CORE * spark.sparkContext.defaultParallelism < 300
        assert sorted(r["html"] for r in pages.collect()) == sorted(names[:300])
        assert "InMemoryFileIndex(3 paths)" in plan_of(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_files_are_replaced_whole_and_as_they_are(spark, tmp_path):
    from haggle.plans import outputs

    made = spark.createDataFrame([("x/a.gz", "1"), ("x/y/b", "둘\r\n"), ("c", "")], "name string, value string")
    for _ in range(2):
        outputs.write_files(made, f"file://{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"x/a.gz": "1", "x/y/b": "둘\r\n", "c": ""}


def test_served_pages_are_files_that_tasks_put_in_place(spark, monkeypatch, tmp_path):
    from haggle import queries_feeds

    monkeypatch.setattr(queries_feeds, "shared_folder", lambda spark, kind: f"file://{tmp_path}/{kind}")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT i AS page_id, 'https://x.example/' AS url, '<title> t' || i || '</title>' || repeat('é' || chr(10), i + 1) AS html FROM (SELECT unnest([0, 1, 2, 1999, 2000]) AS i)")
    (tmp_path / "in").mkdir()
    con.execute(f"COPY pages TO '{tmp_path}/in/pages.parquet'")
    same(spark, con, str(tmp_path / "in"), "page_table")
    files = sorted(str(p.relative_to(tmp_path / "served/pages")) for p in (tmp_path / "served/pages").rglob("*") if p.is_file())
    assert files == ["0/0.txt", "0/1.txt", "0/2.txt", "1/1999.txt", "2/2000.txt"]
