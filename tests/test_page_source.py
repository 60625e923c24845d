"""The data source of pages: as a table, as a stream, and after a restart."""

import pytest

from haggle.sources import page_source
from haggle.sources.fetch import fetch_pages

ASKED = "/asked.txt"


def counting_get(url):
    """Leaves a line for every request in the folder that the address names."""
    folder, _, name = url.partition("::")
    with open(folder.removeprefix("count://") + ASKED, "a") as f:
        f.write(name + "\n")
    if name.endswith("lost"):
        raise OSError("gone")
    return 200, url, name, f"<p>{name}"


@pytest.fixture
def log(spark, tmp_path):
    page_source.register(spark)
    return page_source.AddressLog(spark, f"file://{tmp_path}/log")


def addresses(spark, folder, *names):
    return spark.createDataFrame([(f"count://{folder}::{n}",) for n in names], "url string")


def asked(folder):
    return sorted((folder / ASKED[1:]).read_text().split())


OPTIONS = {"get": "tests.test_page_source:counting_get", "delay": "0"}


def test_the_source_gives_the_rows_of_fetch_pages(spark, tmp_path, log):
    rows = addresses(spark, tmp_path, "a", "b", "lost", "a").union(spark.createDataFrame([(None,), (" ",)], "url string"))
    assert log.append(rows) == 1 and log.append(addresses(spark, tmp_path, "c")) == 2
    got = spark.read.format("pages").options(**OPTIONS).load(log.path)
    want = fetch_pages(addresses(spark, tmp_path, "a", "b", "lost", "c"), get=counting_get, delay=0)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert asked(tmp_path) == sorted(["a", "b", "lost", "c"] * 2)
    empty = page_source.AddressLog(spark, f"file://{tmp_path}/none")
    assert spark.read.format("pages").load(empty.path).count() == 0
    with pytest.raises(Exception, match="address log"):
        spark.read.format("pages").load().count()


def test_one_task_asks_a_host(spark, tmp_path, log):
    hosts = [f"http://h{i % 7}.example/{i}" for i in range(70)]
    log.append(spark.createDataFrame([(u,) for u in hosts], "url string"))
    log.append(spark.createDataFrame([("http://h1.example/again",)], "url string"))
    tasks = page_source.lanes(log.path, page_source.finished(log.path))
    assert len(tasks) == 7 and sorted(len(t.folders) for t in tasks) == [1] * 6 + [2]


def test_a_stream_that_starts_again_fetches_nothing_twice(spark, tmp_path, log):
    def run():
        pages = spark.readStream.format("pages").options(**OPTIONS).load(log.path)
        stream = pages.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert stream.awaitTermination(120)
        return sorted(r.title for r in spark.read.parquet(f"{tmp_path}/out").collect())

    log.append(addresses(spark, tmp_path, "a", "b"))
    assert run() == ["a", "b"] and asked(tmp_path) == ["a", "b"]
    assert run() == ["a", "b"] and asked(tmp_path) == ["a", "b"]
    log.append(addresses(spark, tmp_path, "c", "a"))
    # A batch that is not whole does not count.
    (tmp_path / "log" / "batch-0000000003" / "lane=1").mkdir(parents=True)
    assert run() == ["a", "a", "b", "c"] and asked(tmp_path) == ["a", "a", "b", "c"]
    assert log.append(addresses(spark, tmp_path, "d")) == 3 and run() == ["a", "a", "b", "c", "d"]
