import itertools
import math

import numpy as np

import corpus_pipeline
from haggle.llm import bpe, mixing, near_dup, quality
from haggle.llm.queries import SOURCE_WEIGHTS

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality_scores(docs, labels).collect()}
    good = docs.where(docs.doc_id.isin([d for d, k in verdict.items() if k]))
    heads = [r.doc_id for r in near_dup.near_duplicates(good).collect() if r.kept]
    unique = good.where(good.doc_id.isin(heads))
    order = [r.doc_id for r in sorted(mixing.mix(unique, SOURCE_WEIGHTS).collect(), key=lambda r: r.position)]
    codec = bpe.codec(bpe.tokenizer_path())
    text = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == order
    assert 0 < len(got) < 200
    for r in got:
        assert r.ids == codec.encode(text[r.doc_id]) and r.exact and r.n_tokens == len(r.ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "mixing", "bpe"]


def test_stages_keep_all_columns_and_odd_rows(spark):
    rows = [(i, f"word{i} and some more words {i} here to read", "en", f"src{i % 3}", 1, "x") for i in range(30)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "src1", 0, "y"), (None, "no id but words in here too", "en", "src2", 3, "z")]
    rows += [rows[0], rows[0], (None, None, None, None, None, None), (102, "x " * 60000, "en", "src1", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    before = docs
    judged = {(r.doc_id, r.kept) for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    gone = {d for d, kept in judged if not kept}
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns
    got = docs.collect()
    assert len(got) == len(rows) - 2 - len(gone) and not {r.doc_id for r in got} & gone
    assert sum(r.text is None for r in got) == 2
    out = corpus_pipeline.bpe_stage(spark, docs, SF).collect()
    assert len(out) == len(got)
    empty = corpus_pipeline.quality_stage(spark, before.limit(0), SF)
    for _, stage in corpus_pipeline.STAGES[1:]:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 5 = 0")
    rows = quality.quality_scores(docs, labels.where("doc_id % 5 <> 0")).join(held, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [not r.kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert sum(clean) / len(clean) > 0.99
    assert sum(bad) / len(bad) > 0.95


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "THE!! END!! " * 3000, 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in quality.quality_scores(docs).collect()}
    assert len(got) == 3 and got[1].labellers == got[2].labellers == ""
    model = quality.fit(docs)
    assert got[1].score == 1 / (1 + math.exp(-model.bias))
    assert quality.style("") == ([0.0] * 8, [], 0)
    assert quality.quality_scores(docs.limit(0)).count() == 0


def test_mixed_order_survives_files_of_unequal_size(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " + "pad " * (i % 7 * 40), f"src{i % 3}") for i in range(3000)], "doc_id long, text string, source string").cache()
    order = [r.doc_id for r in sorted(mixing.mix(docs, SOURCE_WEIGHTS).collect(), key=lambda r: r.position)]
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    mixed.write.parquet(f"{tmp_path}/mixed")
    for back in (spark.read.parquet(f"{tmp_path}/mixed"), mixed):
        got = corpus_pipeline.bpe_stage(spark, back, SF).select("doc_id", "position").collect()
        assert [r.doc_id for r in got] == order
        assert [r.position for r in got] == list(range(len(order)))


def test_the_pipeline_returns_the_mixed_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = near_dup.deduplicate(quality.quality_filter(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    order = [r.doc_id for r in sorted(mixing.mix(kept, SOURCE_WEIGHTS).collect(), key=lambda r: r.position)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert [r.doc_id for r in got] == order and [r.position for r in got] == list(range(len(order)))


def test_estimate_matches_expectation_maximisation_by_hand():
    """The same rounds, class by class and labeller by labeller, in plain Python."""
    rng = np.random.default_rng(1)
    k, classes = len(quality.LABELLERS), len(quality.CLASSES)
    patterns = np.unique(rng.integers(0, 1 << k, 40))
    counts = rng.integers(1, 200, len(patterns))
    share, rate, post = quality.estimate(patterns, counts, rounds=7)
    prior = [[0.01 if c == 0 else 0.5 if speaks == c else 0.02 for _, speaks in quality.LABELLERS] for c in range(classes)]
    r, s, total = [row[:] for row in prior], [0.8, 0.1, 0.1], int(counts.sum())
    strength = 0.02 * total + 1
    for _ in range(7):
        p = []
        for pattern in patterns.tolist():
            like = [s[c] * math.prod(r[c][i] if pattern >> i & 1 else 1 - r[c][i] for i in range(k)) for c in range(classes)]
            p.append([x / sum(like) for x in like])
        for c in range(classes):
            mass = sum(q[c] * n for q, n in zip(p, counts.tolist()))
            s[c] = (mass + 1) / (total + classes)
            for i in range(k):
                spoke = sum(q[c] * n for q, n, pattern in zip(p, counts.tolist(), patterns.tolist()) if pattern >> i & 1)
                r[c][i] = min(1 - 1e-4, max(1e-4, (spoke + strength * prior[c][i]) / (mass + strength)))
    assert np.allclose(share, s) and np.allclose(rate, r) and np.allclose(post, p)


def test_scorer_reaches_the_least_loss_and_counts_copies():
    """Against many small steps of plain proximal gradient on the same loss."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(60)]
    target = rng.random(60)
    copies = rng.integers(1, 4, 60)
    weight, bias = quality.fit_linear(rows, target, copies, sparsity=0.01, rounds=3000)
    again, bias_again = quality.fit_linear([r for r, n in zip(rows, copies) for _ in range(n)], np.repeat(target, copies), sparsity=0.01, rounds=3000)
    assert np.allclose(weight, again, atol=1e-5) and abs(bias - bias_again) < 1e-5
    x = np.zeros((60, 13))
    for i, row in enumerate(rows):
        x[i, row] = 1
    x[:, 12] = 1
    w, n = np.zeros(13), copies / copies.sum()
    for _ in range(20000):
        w = w - 0.2 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - target)))
        w[:12] = np.sign(w[:12]) * np.maximum(np.abs(w[:12]) - 0.2 * 0.01, 0)
    assert np.allclose(weight[:12], w[:12], atol=1e-3) and abs(bias - w[12]) < 1e-3


def test_copies_move_into_the_sample_one_by_one(spark):
    texts = [f"clean text of the table number {i} with words" for i in range(3)]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(3000)] + [(7, "one row many times")] * 2000, "doc_id long, text string")
    picked = quality.sampled(docs, 200).collect()
    assert 100 < len(picked) < 320 and {r.text for r in picked} >= set(texts)
    assert sum(r.copies for r in quality.sampled(docs, 100000).collect()) == 5000
    assert quality.quality_scores(docs, train_rows=50).where("kept").count() == 5000


def test_scores_follow_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).where("doc_id < 60").collect()}
    for r, (d, t) in itertools.product(got.values(), [(r.doc_id, r.text) for r in docs.where("doc_id < 60").collect()]):
        if r.doc_id == d:
            measures, words, insults = quality.style(t or "")
            pattern = quality.votes(measures, words, insults, model.lexicon)
            assert r.labellers == ",".join(n for i, (n, _) in enumerate(quality.LABELLERS) if pattern >> i & 1)
            assert r.kept == (max(r.posterior, r.score) < 0.5)
