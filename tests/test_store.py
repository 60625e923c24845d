"""The store: commits, replayed batches, writers side by side, buckets and the search's posting table."""

import pytest
from pyspark.sql import functions as F

from haggle.operators import store as S
from haggle.operators.filters import search
from haggle.operators.ledger import Ledger

SCHEMA = "product_name string, product_url string, platform string, data_source string"


def rows(spark, *pairs):
    return spark.createDataFrame([(n, u and f"https://x.example/{u}", "test", "d") for n, u in pairs], SCHEMA)


def held(store):
    return sorted((r.id, r.product_name) for r in store.products.collect())


def test_a_named_batch_is_stored_once(spark, tmp_path):
    store = S.ProductStore(spark, str(tmp_path), buckets=2)
    batch = rows(spark, ("A", "1"), ("B", None), ("A2", "1"))
    assert [store.add_new(batch, ("product_name",), "one").count() for _ in range(3)] == [2, 2, 2]
    assert store.add_new(rows(spark), ("product_name",), "none").count() == 0
    again = S.ProductStore(spark, str(tmp_path), buckets=7)
    assert again.buckets == 2 and again.add_new(batch, ("product_name",), "one").count() == 2
    assert again.add_new(batch, ("product_name",), "two").count() == 1
    assert held(store) == held(again) == [(1, "A"), (2, "B"), (3, "B")]


def test_a_writer_that_comes_second_numbers_and_looks_again(spark, tmp_path, monkeypatch):
    one, two = (S.ProductStore(spark, str(tmp_path), buckets=2) for _ in range(2))
    first, commit = [], Ledger.commit

    def late(self, number, entry):
        if not first:
            first.append(number)
            two.add_new(rows(spark, ("B", "1"), ("C", "2")), ("product_name",), "two")
        return commit(self, number, entry)

    monkeypatch.setattr(Ledger, "commit", late)
    got = one.add_new(rows(spark, ("A", "1"), ("D", "3"), ("E", None)), ("product_name",), "one")
    assert held(one) == held(two) == [(1, "B"), (2, "C"), (3, "D"), (4, "E")]
    assert sorted(r.product_name for r in got.collect()) == ["D", "E"]
    # Nothing of the first attempt is left.
    assert len(list((tmp_path / "products" / "data").iterdir())) == 2 == len(list((tmp_path / "products" / "grams").iterdir()))
    assert not list((tmp_path / "_stage").iterdir())


def test_ids_follow_the_files_whatever_the_source_does(spark, tmp_path):
    """A source that gives other rows each time it is read, as a fetch or a recomputed partition may."""
    store = S.ProductStore(spark, str(tmp_path), buckets=3)
    spark.range(1).count()
    changing = spark.range(300).repartition(7).select(F.concat(F.lit("p"), F.expr("uuid()")).alias("product_name"), F.lit("test").alias("platform"), F.lit("d").alias("data_source"))
    store.add(changing)
    store.add(changing, ("product_name",))
    ids = [r.id for r in store.products.select("id").collect()]
    assert sorted(ids) == list(range(1, 601))
    staged = store._stage(changing.withColumn("product_url", F.lit(None).cast("string")), str(tmp_path / "again"), ["product_name"])
    numbered, facts = store._numbered(staged, 10)
    assert facts["rows"] == 300 and sorted(map(tuple, numbered.collect())) == sorted(map(tuple, numbered.collect()))
    assert [r.id for r in numbered.orderBy("product_name").collect()] == list(range(11, 311))


def test_stored_rows_are_not_moved_for_a_batch(spark, tmp_path):
    store = S.ProductStore(spark, str(tmp_path), buckets=8)
    store.add(rows(spark, *((f"p{i}", str(i)) for i in range(50)), *((f"q{i}", None) for i in range(50))))
    store.add(rows(spark, ("r", "60")))
    unknown = store.unknown(rows(spark, ("a", "3"), ("b", "60"), ("c", "61"), ("c2", "61"), ("d", None)), ["product_name"])
    plan = unknown._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("LeftAnti") :].split("FileScan parquet")[0].split("Sort [link_key")[1]
    assert "Exchange" not in stored and "Bucketed: true" in plan
    assert sorted(r.product_name for r in unknown.collect()) == ["c", "d"]
    # Rows without a link are spread over the buckets.
    sizes = [r["count"] for r in store._bucketed().where("product_url is null").groupBy(F.pmod("link_key", F.lit(8))).count().collect()]
    assert len(sizes) > 4


def test_a_search_reads_the_files_that_can_hold_its_text(spark, tmp_path):
    store = S.ProductStore(spark, str(tmp_path), buckets=4)
    for k in ("Alpha Rose", "Beta_100%", "Ärger \\ ab", "ab"):
        store.add(spark.createDataFrame([(f"{k} {i}", f"https://x.example/{k[:1]}{i}", "test", "feed", "Rosa" if k == "ab" else None) for i in range(20)], SCHEMA + ", seller string"))
    store.add(spark.createDataFrame([("x", "test", "rose feed")], "product_name string, platform string, data_source string"))
    every = len(store.products.inputFiles())
    for query, fewer in (("ROSE", True), ("rose 1", True), ("a_100%", True), ("eta%100", True), ("Ärg", True), ("\\ ab", True), ("os", False), ("%", False), ("a_b", False), ("nowhere", True), ("feed", False), ("rosa", True), ("eed%ose", True)):
        found = store.searched(query)
        assert sorted(r.id for r in search(found, query).collect()) == sorted(r.id for r in search(store.products, query).collect()), query
        assert (len(found.inputFiles()) < every) is fewer, query
    assert store.searched("nowhere").inputFiles() == [] and store.search("rosa", 5).count() == 5
    assert S.grams_of("A_bCde%") == ["bcd", "cde"]


def test_the_log_of_runs_is_committed_too(spark, tmp_path):
    store = S.ProductStore(spark, str(tmp_path))
    assert store.runs.count() == 0 and store.products.count() == 0 and store.search("abc").count() == 0
    for s in ("failed", "success"):
        store.record("a", "test", s)
    assert [(r.id, r.status) for r in store.runs.orderBy("id").collect()] == [(1, "failed"), (2, "success")]
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("", "test", "d")], "product_name string, platform string, data_source string"))
    assert store.products.count() == 0


def test_a_deep_page_reads_as_few_files_as_the_first(spark, tmp_path):
    store = S.ProductStore(spark, str(tmp_path), buckets=1)
    for k in range(8):
        when = F.timestamp_micros(F.lit(1_700_000_000_000_000 + (k % 6) * 1_000_000) + (F.col("id") % 4) * 300_000)
        store.add(spark.range(10).select(F.concat(F.lit(f"p{k}-"), "id").alias("product_name"), F.lit("test" if k % 2 else "group_buy").alias("platform"), F.lit("d").alias("data_source"), when.alias("collected_at")))
    want = [r.id for r in store.products.orderBy(*store._newest()).collect()]
    got, key, read = [], None, []
    while True:
        page = store.list(limit=7, after=key)
        rows = page.select("collected_at", "id").collect()
        if not rows:
            break
        read.append(len(page.inputFiles()))
        got += [r.id for r in rows]
        key = tuple(rows[-1])
    assert got == want and len(got) == 80
    assert max(read) <= 4 and read[0] <= 3
    every = [(r.collected_at, r.id, r.platform) for r in store.products.orderBy(*store._newest()).collect()]
    some = [r.id for r in store.list(limit=50, after=every[30][:2], platform="test").collect()]
    assert some == [i for _, i, p in every[31:] if p == "test"] and some
    assert [r.id for r in store.list(limit=5, offset=20).collect()] == want[20:25]
    assert [r.id for r in store.list(limit=5, platform="test").collect()] == [r.id for r in store.products.where("platform = 'test'").orderBy(*store._newest()).limit(5).collect()]
