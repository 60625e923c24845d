import random
import time
from collections import Counter
from itertools import islice

import numpy as np

from haggle.llm import common, components, near_dup, words


def bag(text):
    words = (text or "").encode().translate(near_dup.TO_LOWER).split()
    return Counter(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            both = sum((bags[i] & bags[k]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[k].values()) - both) - 1e-9:
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    element = rng.integers(1, 2**63, 300).astype(np.uint64)
    a = rng.integers(1, 20, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.integers(1, 60, 300))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = near_dup.bag_signatures(np.repeat([0, 1], 300), np.tile(element, 2), np.concatenate([a, b]), 2, 3000)
    assert abs((s[0] == s[1]).mean() - true) < 0.04


def test_classes_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(text)))
    base = [word() for _ in range(120)]
    for _ in range(60):  # one large group around the threshold
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = word()
        rows.append((len(rows), " ".join(text)))
    for odd in (None, "", "  \n", "one two", "ONE  two", "x " * 4000):
        rows.append((len(rows), odd))
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    docs = spark.createDataFrame([(d, t, "c", "n") for d, t in rows], "doc_id long, text string, class string, node string")
    got = near_dup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_repeated_and_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "z y x w v u"), (None, None)], "doc_id long, text string")
    got = near_dup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None"), ("None", "None")]
    assert sum(r.kept for r in got) == 3
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark):
    """Rounds of components and sketches are many: what each has shuffled goes when it ends."""
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(4)
    before = shuffle_files(spark)
    kept = spark.conf.get(common.CLEANUP)
    rooted = common.cut(components.components(links))
    components.heavy_keys(rooted, "root")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(common.CLEANUP) == kept
    assert rooted.where("root = 0").count() == rooted.count() == 201


def test_deduplicate_leaves_no_shuffle_files(spark):
    """What the pipeline's stage has worked out before its last join keeps no shuffle files."""
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 3}") for i in range(12)], "doc_id long, text string").repartition(4)
    before = shuffle_files(spark)
    one = near_dup.deduplicate(docs)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert [r.doc_id for r in one.orderBy("doc_id").collect()] == [0, 3, 6, 9]


def test_query_matches_sql(spark):
    import duckdb

    from haggle.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.sql(ORACLE_SQL["op2_near_dup"]).df()[["doc_id", "class_id", "kept"]].values.tolist()))
    got = sorted((r.doc_id, r.class_id, r.kept) for r in QUERIES["op2_near_dup"](spark, sf).collect())
    assert got == want


def test_long_words_behind_short_ones_are_cut_once():
    long = "x" * (3 << 20)
    for text in (f"a {long}", f"{long} b {long} c", f" {long}", f"a b {long}  {'y ' * (1 << 20)}z"):
        raw = text.encode()
        parts = list(islice(words._cut_points(raw), 50))
        assert b"".join(parts) == raw and all(parts)
        hashes, counts = words.hash_texts(["p q", text, "r"])
        assert list(counts) == [2, len(text.split()), 1]
        singly, _ = words.hash_texts([w for w in text.split()][:3])
        assert list(hashes[2 : 2 + len(singly)]) == list(singly)
