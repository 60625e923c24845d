"""URL filters, collocations and lexical search against SQL and brute force, and on odd inputs."""

import glob
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from haggle.llm import collocations, lexical, url_filter
from haggle.llm.queries import ORACLE_SQL, QUERIES
from haggle.llm.url_filter import Rule

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_collocations", "op13_lexical_search"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    key = lambda d: sorted(map(tuple, d[sorted(want.columns)].astype(object).where(d.notna(), None).astype(str).values))
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 0
    assert key(got) == key(want)


# -- URLs ------------------------------------------------------------------------------------------------


def slow_verdict(url, rules, globs):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    path = re.match(r"[^?#]*", tail)[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: len(r.text))
        return host, path, best.text, best.action
    seen = "." + host + path + (re.match(r"\?[^#]*", tail[len(path) :]) or [""])[0]
    shapes = ["".join(".*" if t == "**" else "[^/?]*" if t == "*" else re.escape(t) for t in url_filter.glob_pattern(g)) for g in globs]
    return host, path, None, "block" if any(re.fullmatch(s, seen, re.S) for s in shapes) else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.NET/", "http://xnet/", "http://a.b.net?x=/", "http://a.net#/", "http://example.net/en/", "http://www.example.net/en/7?q#f",
    "http://example.net/EN/", "http://example.net/en", "http://notexample.net/en/", "https://user@example.com:80/de/", "https://example.com/de/x", "https://a.example.com/fr/", "https://w.org/fr/é", "https://w.org/fr",
    "http://x.com/a://b.net/", "http://a.com/.net/", "http://a.com?.net/", "http://best-casino.example.com", "http://x.com/casino", "http://ads.x.com/a", "http://myads.x.com/", "http://spam-a.b.com/x", "http://spam-a/b.com",
    "http://x.com/a.exe", "http://x.com/a.exe?v=1", "http://x.com/?a.exe", "http://x.com/#a.exe", "http://x.com/y/wp-login.php?x", "http://x\ny.net/\n", "http://日本.net/", "ftp://" + "a." * 4000 + "net/" + "x" * 20000, "http://x.com/" + "y" * 9000 + ".exe",
]


def test_urls_as_by_regular_expressions(spark):
    rng = random.Random(4)
    pool = ["://", "/", "?", "#", ".", "net", "example", "com", "org", "fr", "de", "en", "casino", "ads", "A", "x", "spam-", ".exe"]
    urls = URLS + ["http://" + "".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(600)] * 2
    pages = spark.createDataFrame([(i, u, "clash", 7) for i, u in enumerate(urls)] + [(None, "http://net/", "no id", 7)], "page_id long, url string, verdict string, _code int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls) + 1 and got.pop(None) == ("net", "/", "net/", "block")
    assert got == {i: slow_verdict(u, url_filter.RULES, url_filter.BLOCK_GLOBS) for i, u in enumerate(urls)}
    kept = url_filter.allowed_pages(pages)
    assert kept.columns == pages.columns and {r.page_id for r in kept.collect()} == {i for i, v in got.items() if v[3] == "allow"}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [], []).collect()} == {"allow"}


def test_many_patterns_over_many_words_of_state(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab.") for _ in range(rng.randrange(1, 6)))
    globs = ["".join(rng.choice(["*", "**", word(), "/"]) for _ in range(rng.randrange(1, 7))) for _ in range(90)]
    automaton = url_filter.Automaton([url_filter.glob_pattern(g) for g in globs])
    assert automaton.words > 3
    urls = ["".join(rng.choice("ab./?") for _ in range(rng.randrange(14))) for _ in range(300)]
    states = automaton.states(pa.array(["skipped", *urls]).slice(1))
    for i, g in enumerate(globs):
        shape = re.compile("".join(".*" if t == "**" else "[^/?]*" if t == "*" else re.escape(t) for t in url_filter.glob_pattern(g)))
        assert automaton.matches(states, i).tolist() == [bool(shape.fullmatch(u)) for u in urls], g
    assert [automaton._packed([automaton.follow(u.encode())])[0].tolist() for u in urls[:50]] == states[:50].tolist()
    with pytest.raises(ValueError):
        url_filter.verdicts([Rule("block", "net", "no-slash")], [])


# -- collocations ----------------------------------------------------------------------------------------


def slow_collocations(rows, least, longest, top, covered):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        chosen = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        rows = []
        for p, a in chosen.items():
            if held[p] and 100 * held[p] >= covered * a:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,longest,parts", [(3, 3, False), (2, 4, True), (300, 3, False), (1, 2, False)])
def test_collocations_as_counted_by_hand(spark, least, longest, parts):
    rng = random.Random(6)
    words = ["a", "A", "b", "é", "of", "the", "\x00", "\x1c", "日本", "x\u00a0y", "zz"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "! ", " ; "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " ", ".", "...", "a a a a a a", "a b " * 400, "a" * 5000, "a b. " * 300, "of the " * 200_000 + "end of the", "Of The, " * 200_000]
    rows = [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = collocations.collocations(docs, least, longest, 40, 50, candidates=60 if parts else collocations.CANDIDATES)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == slow_collocations(rows, least, longest, 40, 50)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_read_texts_equally_often_however_many_candidates(spark):
    rng = random.Random(8)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(200))) for _ in range(40)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2).mapInArrow(counted, "lang string, text string")
    seen, got = [], []
    for candidates in (collocations.CANDIDATES, 20):
        before = read.value
        got.append(sorted(map(tuple, collocations.collocations(docs, 3, 3, 40, 50, candidates=candidates).collect())))
        seen.append(read.value - before)
    assert got[0] == got[1] == slow_collocations(rows, 3, 3, 40, 50)
    assert seen[0] == seen[1] <= 3 * len(rows)


def test_sketch_bounds_from_above():
    rng = np.random.default_rng(1)
    sketch, true = collocations.Sketch(10, width=257), Counter()
    for _ in range(20):
        keys = np.unique(rng.integers(0, 900, 300).astype(np.uint64))
        counts = rng.integers(1, 4, len(keys))
        bound = sketch.add(keys, counts)
        for k, c, b in zip(keys.tolist(), counts.tolist(), bound.tolist()):
            true[k] += c
            assert min(true[k], 10) <= b <= 10


def test_exact_scores_beyond_64_bits(spark):
    n = 3 * 10**12
    counts = spark.createDataFrame([("x", "a", n), ("x", "b", n + 1), ("x", "a b", n - 1), ("x", "", 9 * n)], "lang string, phrase string, n long")
    row = collocations.ranked(counts, 10, 5, 50).first()
    assert row.score == 10**6 * (n - 1) ** 2 // (n * (n + 1))


# -- lexical search --------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_search(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms_of(x)) for i, x in docs) if t]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = set(terms_of(text))
        found = [(sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * m * n // length))) for t in asked & c.keys()), i) for i, c, m in held]
        best = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], lexical.NO_ID if x[1] is None else x[1]))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def test_search_as_by_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(400)] + ["É", "Straße", "A1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(-20, 500)]
    docs += [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2"), (None, None), (501, ""), (502, "?!"), (503, "w3 " * 50_000), (10**15, "W5-w6_w7")] + [(600 + i, "w1 w2 w9") for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, "never seen"), (3, "w1 w2"), (None, "w9"), (63, "w1 W1 w1")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, row string, score int").repartition(6)
    q = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, rank string")
    for size in (lexical.BLOCK_BYTES, 800):
        got = lexical.ranked_search(d, q, k=7, block_bytes=size)
        assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == slow_search(docs, items, 7)
    assert lexical.ranked_search(d.limit(0), q).count() == 0 and lexical.ranked_search(d, q.limit(0)).count() == 0


def test_merge_over_many_shards_keeps_the_best():
    rng = random.Random(8)
    for _ in range(150):
        best, every = [], []
        for _ in range(4):
            n = rng.randrange(1, 40)
            ids = sorted(rng.sample(range(1000), n))
            tf = [{p: rng.randrange(1, 4) for p in sorted(rng.sample(range(n), rng.randrange(1, n + 1)))} for _ in range(rng.randrange(1, 7))]
            norms = [rng.randrange(10, 300) for _ in ids]
            lists = [lexical.Postings(lexical.packed(np.diff(list(t), prepend=0)), lexical.packed(np.array(list(t.values()))), rng.choice([1, 5, 900]), norms) for t in tf]
            total = Counter()
            for x in lists:
                for p, s in zip(x.places, x.adds):
                    total[p] += s
            every += [(s, -ids[p]) for p, s in total.items() if s > 0]
            lexical.merge(lists, ids, best, 5)
        assert sorted(best) == sorted(every)[-5:]
