import math

import numpy as np

from haggle.llm import embed_dup, top_k

SCHEMA = "vec_id long, embedding array<float>, score long, code int"


def rows():
    rng = np.random.default_rng(2)
    out = []
    for _ in range(8):
        base = rng.standard_normal(12)
        for _ in range(12):
            v = base + rng.standard_normal(12) * rng.choice([0.0, 0.1, 0.35])
            out.append((len(out), [float(np.float32(c)) for c in v], 0, 0))
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] * 12, [2.0] * 12, [1.0] * 12, [1.0, 1.0]]
    return out + [(len(out) + i, v, 0, 0) for i, v in enumerate(odd)]


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def brute_links(data):
    usable = {i: v for i, v, *_ in data if good(v) and any(v)}
    link = {i: {k for k, w in usable.items() if k != i and len(w) == len(usable[i]) and cosine(usable[i], w) >= 0.9} if i in usable else set() for i, *_ in data}
    least = {i: i for i in link}
    while True:
        new = {i: min([least[i], *(least[k] for k in link[i])]) for i in link}
        if new == least:
            return {i: (len(link[i]), least[i], least[i] == i) for i in link}
        least = new


def test_links_match_brute_force(spark, monkeypatch):
    data = rows()
    for block in (1024, 8):
        monkeypatch.setattr(embed_dup, "BLOCK", block)
        got = embed_dup.link_vectors(spark.createDataFrame(data, SCHEMA)).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(data)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(300):
        a = rng.standard_normal(32)
        b = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        t = math.acos(0.9005)
        data += [(2 * i, a.tolist(), 0, 0), (2 * i + 1, (math.cos(t) * a + math.sin(t) * b).tolist(), 0, 0)]
    got = embed_dup.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, x int, y int"))
    assert got.where("n_links = 1").count() >= 598


def test_repeated_null_and_empty(spark):
    got = embed_dup.link_vectors(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [2.0]), (None, None)], "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dup.link_vectors(none).count() == 0
    assert top_k.top_k(none).count() == 0


def test_top_k_matches_brute_force(spark, monkeypatch):
    data = [(i, v, 0, 0) for i, v, *_ in rows()]
    monkeypatch.setattr(top_k, "SHARD_ROWS", 16)
    monkeypatch.setattr(top_k, "LEAF", 4)
    got = {}
    for r in top_k.top_k(spark.createDataFrame(data, SCHEMA), k=7, every=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {i: [math.floor(64 * c) for c in v] for i, v, *_ in data if good(v)}
    want = {}
    for q in ints:
        if q % 4 == 0:
            s = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q)[:7]
            want[q] = [(n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert {q: sorted(v) for q, v in got.items()} == want


def brute_top(data, k, every):
    """``data``: (id, vector); repeated rows each for themselves."""
    ints = [(i, [math.floor(64 * c) if abs(c) < 1e300 else 64 * int(c) for c in v]) for i, v in data if good(v) and i is not None]
    clip = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    out = {}
    for q, v in ints:
        if q % every == 0:
            s = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in ints if i != q)[:k]
            out[q, tuple(v)] = [(n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(x for rows in out.values() for x in rows)


def test_top_k_of_large_components_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 16)
    monkeypatch.setattr(top_k, "LEAF", 4)
    monkeypatch.setattr(top_k, "NEAR", 2)
    rng = np.random.default_rng(8)
    data = [(i, rng.standard_normal(5).tolist()) for i in range(140)]
    data += [(3, [1.0] * 5), (4, [1.0] * 5), (4, [1.0] * 5), (8, [2.0, 1.0]), (None, [9.0] * 5), (150, []), (151, None)]
    data += [(160 + i, [float(f"{rng.standard_normal():.3f}") * 10.0 ** int(rng.integers(3, 15)) for _ in range(5)]) for i in range(24)]
    data += [(200, [1e305, -1.0]), (201, [-1e305, 2.0]), (204, [20000.0, 1.0]), (208, [1.0, 20000.0])]
    got = top_k.top_k(spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, x string"), k=6, every=4).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == brute_top(data, 6, 4)
    none = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert top_k.top_k(none).count() == 0


def test_all_vectors_equal(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 8)
    monkeypatch.setattr(embed_dup, "BLOCK", 4)
    data = [(i, [0.5, 0.25]) for i in range(50)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = top_k.top_k(df, k=5, every=10).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == brute_top(data, 5, 10)
    linked = embed_dup.link_vectors(df).collect()
    assert {(r.n_links, r.component_id) for r in linked} == {(49, 0)} and sum(r.kept for r in linked) == 1


def test_a_large_cluster_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "BLOCK", 64)
    monkeypatch.setattr(embed_dup, "PAIRS_AT_ONCE", 100)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    data = [(i, (base + 0.05 * rng.standard_normal(16)).tolist(), 0, 0) for i in range(300)]
    got = embed_dup.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, x int, y int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(data)
