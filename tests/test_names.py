"""The two ways of reading product names agree."""

import random

from pyspark.sql import functions as F

from haggle.functions import names as N
from haggle.functions import text as T

BITS = [
    "삼성 갤럭시", "S25", "256GB", "블랙", "티타늄", " ", "  ", "/", " / ", "12,345원", "1234", "판매가: ", "출시가", "CPU: i7", "cpu :", "RAM", "닫기", "vs상품비교", "VS상품비교", "3 몰", "2위", "ultra", "울트라", "ab", "a",
    "자급제", "핑크,", "\t", "　", "\x1c", "é", "K", "ſ5", "oſ: x", "１２３４", "x" * 130, "new 새로워진 상품비교 기능", "1,2", "원", "：", "İ", "ΑΣ",
]


def texts():
    rng = random.Random(11)
    return [None, "", " "] + BITS + ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]


def test_expressions_and_batches_score_alike(spark):
    queries = ["갤럭시 s25 a", None, "  Ultra  블랙 "]
    rows = [(i, t, queries[i % 3]) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "i int, t string, q string").repartition(3)
    parts = F.transform(T.name_parts(T.squash(F.col("t"))), lambda p: F.struct(p["name"].alias("name"), p["joined"].alias("joined"), T.name_score(p["name"], T.query_terms(F.col("q"))).alias("score")))
    got = {r.i: r for r in df.select("i", T.clean_name(F.col("t")).alias("clean"), parts.alias("parts"), N.names(T.squash(F.col("t")), F.col("q")).alias("names")).collect()}
    for i, t, q in rows:
        r = got[i]
        one = N.usable(t)
        assert r.clean == one and r.names.clean == (one if t is not None and t.split() else None), repr(t)
        squashed = " ".join((t or "").split())
        assert [(p.name, p.joined) for p in r.parts or []] == (N.parts(squashed) if squashed else []), repr(t)
        for p in r.parts or []:
            assert abs(p.score - N.points(p.name, N.terms(q))) < 1e-9, repr(p.name)
        scored = [(p.score, -k, p.name, p.joined) for k, p in enumerate(r.parts or []) if p.score > -50]
        for kind, less in (("plain", 0.0), ("late", 2.0)):
            want = max(((s - less * j, k, n) for s, k, n, j in scored), default=(None, None, None))
            have = r.names[kind]
            assert (have.place, have.name) == want[1:] and (want[0] is None or abs(have.score - want[0]) < 1e-9)
