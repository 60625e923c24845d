import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from haggle.llm import lm_score

ROWS = [
    (1, "The cat sat on the mat. The cat"),
    (2, "the cat\tsat"),
    (3, None),
    (4, ""),
    (5, "a dog\x0bsat on\nthe mat the cat sat"),
    (5, "a dog\x0bsat on\nthe mat the cat sat"),
    (None, "Épée épée  x"),
    (16, "unseen words only here"),
    (7, "word " * 5000),
]


def brute(rows):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    tokens = lambda s: re.findall(r"[^\x20\x09-\x0D]+", lower(s)) + [None]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(t for d, s in rows if not out(d) for t in tokens(s))
    n, v = sum(c.values()), len(c)
    return sorted(
        (
            (str(d), out(d), len(tokens(s)), sum(c[t] > 0 for t in tokens(s)), n,
             round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(s)), 6))
            for d, s in rows
        )
    )


def test_base_matches_brute_force_on_both_ways(spark):
    docs = spark.createDataFrame([(d, s, 0.0) for d, s in ROWS], "doc_id long, text string, score double")
    assert any(lm_score.held_out(d) for d, _ in ROWS) and not all(lm_score.held_out(d) for d, _ in ROWS)
    by_way = []
    for bound in (1 << 30, 0):
        rows = lm_score.lm_scores(docs, broadcast_bytes=bound).collect()
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
        assert got == brute(ROWS)
        assert all(r.score <= 0 for r in rows)
        by_way.append(sorted((str(r.doc_id), round(r.score, 6)) for r in rows))
    # The filter may take an absent n-gram for a present one; nearly all scores agree exactly.
    close = sum(abs(a[1] - b[1]) < 0.05 * abs(b[1]) + 1e-6 for a, b in zip(*by_way))
    assert close == len(ROWS)


def test_empty_table(spark):
    assert lm_score.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_are_the_filters_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(10**15 + 7, None), (None, "w1 w2"), (None, ""), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (str(r.doc_id), r.score)
    sent, routed = (sorted(lm_score.lm_scores(docs, broadcast_bytes=b).collect(), key=key) for b in (1 << 30, 0))
    assert sent == routed
    assert len(sent) == len(rows)


def test_pairs_seen_once_count(spark):
    ids = [i for i in range(40) if not lm_score.held_out(i)][:2] + [next(i for i in range(40) if lm_score.held_out(i))]
    docs = spark.createDataFrame(list(zip(ids, ("alpha beta gamma", "delta alpha delta", "alpha beta"))), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.lm_scores(docs).collect()}[ids[2]]
    # 8 tokens of 5 kinds in training; counts quantise to themselves up to 2 (1.. 2-3 -> 2.5).
    of = {"alpha": 2.5, "beta": 1.0, None: 2.5}
    alone = {w: (c + 1) / (8 + 5 + 1) for w, c in of.items()}
    p = [0.4 * 1 / 2 + 0.6 * alone["alpha"], 0.4 * 1 / 2.5 + 0.6 * alone["beta"], 0.6 * alone[None]]
    assert abs(got - sum(map(math.log10, p))) < 1e-9


def test_scores_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(1, 40)))) for i in range(600)]
    tokens = lambda s: [*s.split(), None]
    train = [tokens(s) for d, s in rows if not lm_score.held_out(d)]
    words = Counter(t for ts in train for t in ts)
    pairs = Counter(p for ts in train for p in zip([0, *ts], ts))
    middle = lambda c: (2.0 ** (c.bit_length() - 1) + 2.0 ** c.bit_length() - 1) / 2 if c else 0.0
    total, distinct = sum(words.values()), len(words)

    def one(ts):
        out = 0.0
        for before, t in zip([0, *ts], ts):
            alone = (min(middle(words[t]), total) + 1) / (total + distinct + 1)
            context, both = (len(train) if before == 0 else middle(words[before])), middle(pairs[before, t])
            out += math.log10(0.4 * both / max(context, both) + 0.6 * alone if context and both else (0.6 if context else 1.0) * alone)
        return out

    got = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: one(tokens(s)) for d, s in rows}
    # A text's score differs only where one of its n-grams is read too high (see the share below).
    same = sum(abs(got[d] - want[d]) < 1e-9 for d in got)
    asked = sum(3 * (len(s.split()) + 1) for _, s in rows) / len(rows)
    assert same > (1 - MISREAD) ** asked * 0.9 * len(rows) and all(abs(got[d] - want[d]) < 0.05 * abs(want[d]) for d in got)


#: N-grams whose level the filter reads too high: about 0.8 % at ten bits and seven probes.
MISREAD = 0.012


def test_the_filter_reads_no_count_too_low_and_few_too_high():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64))
    held, absent = keys[::2], keys[1::2]
    counts = np.ceil(rng.pareto(1.0, len(held)) + 1e-9).astype(np.int64)
    bits = np.frombuffer(lm_score.build_filter(held, counts), np.uint8)
    read, none = lm_score.probed(bits, held, len(bits) * 8), lm_score.probed(bits, absent, len(bits) * 8)
    assert (read >= lm_score.level(counts)).all()
    assert 0 < (read > lm_score.level(counts)).mean() < MISREAD and 0 < (none > 0).mean() < MISREAD


def test_shards_follow_the_corpus_and_change_no_base_score(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for size in (1 << 23, 3000):
        monkeypatch.setattr(lm_score, "SHARD_BYTES", size)
        for bound in (1 << 30, 0):
            got = lm_score.lm_scores(docs, broadcast_bytes=bound).collect()
            assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
