"""A quality classifier without hand labels.

Overlapping heuristic labellers vote on every document.  Expectation-maximisation over the counts
of vote patterns estimates how each labeller behaves on clean, junk and toxic documents and gives
every pattern a posterior.  The posteriors of a bounded sample train a linear model on hashed
words and hashed style levels, and that model scores every document.

Where hand labels exist, a bounded sample of them names a lexicon of words that stand in toxic
documents far more often than in clean ones, and two more labellers look for its words.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches
from .license_scan import words_of

SYMBOLS = b"!#$%&*+<=>@[\\]^_`{|}~"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

# Insults that clean prose does without.
INSULTS = frozenset(
    b"idiot idiots moron morons stupid pathetic worthless disgusting loser losers scum trash clown clowns "
    b"imbecile dumbass bastard bitch asshole retard vermin filthy bullshit fuck fucking shit".split()
)

CLASSES = ("clean", "junk", "toxic")
#: Labeller, the class it speaks for.
LABELLERS = (
    ("symbols", 1),
    ("marked_words", 1),
    ("shouting", 1),
    ("shouted_marks", 1),
    ("stuttering", 1),
    ("few_words", 1),
    ("table_cells", 1),
    ("cell_lines", 1),
    ("insults", 2),
    ("lexicon", 2),
)
#: A lexicon word stands in so many toxic sample documents at least, so many times as often as in clean ones.
LEXICON_LEAST, LEXICON_RATIO = 5, 20
FEATURES = 1 << 18


def style(text: str) -> tuple[list[float], list[bytes], int]:
    """Style measures (each in 0..1), the words, and how many fixed insults stand among them."""
    raw = text.encode()
    spaced = raw.split()
    words = words_of(text)
    n, size = max(1, len(spaced)), max(1, len(raw))
    upper, lower = (len(raw) - len(raw.translate(None, c)) for c in (UPPER, LOWER))
    measures = [
        (len(raw) - len(raw.translate(None, SYMBOLS))) / size,
        sum(w[-2:] in (b"!!", b"##", b"$$", b"%%", b"&&", b"**") for w in spaced) / n,
        upper / max(20, upper + lower),
        raw.count(b"!!") / n,
        sum(map(operator.eq, spaced, spaced[1:])) / n if len(spaced) >= 12 else 0.0,
        1 - len(set(spaced)) / n if len(spaced) >= 30 else 0.0,
        spaced.count(b"|") / n,
        raw.count(b" | ") / (raw.count(b"\n") + 1) / 10,
    ]
    insults = sum(1 for w in words if w in INSULTS)
    return [min(1.0, m) for m in measures], words, insults


LIMITS = (0.05, 0.2, 0.4, 0.2, 0.15, 0.75, 0.15, 0.2)


def votes(measures: list[float], words: list[bytes], insults: int, lexicon: frozenset[bytes]) -> int:
    """Which labellers speak, as bits."""
    # One insult or lexicon word may be chance.  No labeller implies another: what one fact makes
    # several of them say, expectation-maximisation would count as several facts.
    known = len(lexicon.intersection(words)) if lexicon else 0
    fired = [*(m > limit for m, limit in zip(measures, LIMITS)), insults > 1, known > 1]
    return sum(1 << i for i, f in enumerate(fired) if f)


def features(measures: list[float], words: list[bytes]) -> np.ndarray:
    """Hashed features present: each word once, and each style measure's level."""
    found = {zlib.crc32(w) & (FEATURES - 1) for w in words}
    for i, m in enumerate(measures):
        for step in range(1, 7):
            # Levels 1/64, 1/32 ... 1/2: a measure has all levels it reaches.
            if m >= 2.0 ** (step - 7):
                found.add(zlib.crc32(b"\0style %d %d" % (i, step)) & (FEATURES - 1))
    return np.fromiter(found, np.int32, len(found))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class shares, each labeller's rate of speaking in each class, and the patterns' posteriors."""
    k = len(LABELLERS)
    fired = (patterns[:, None] >> np.arange(k)) & 1
    speaks_for = np.array([c for _, c in LABELLERS])
    # Starting point and prior: a labeller speaks on part of its class and hardly elsewhere.
    prior = np.where(speaks_for[None, :] == np.arange(len(CLASSES))[:, None], 0.5, 0.02)
    prior[0] = 0.01
    rate, share = prior.copy(), np.array([0.8, 0.1, 0.1])
    strength = 0.02 * counts.sum() + 1
    for _ in range(rounds):
        log = np.log(share) + fired @ np.log(rate).T + (1 - fired) @ np.log(1 - rate).T
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * counts[:, None]
        share = (mass.sum(axis=0) + 1) / (counts.sum() + len(CLASSES))
        rate = np.clip((mass.T @ fired + strength * prior) / (mass.sum(axis=0)[:, None] + strength), 1e-4, 1 - 1e-4)
    return share, rate, post


def fit_linear(
    rows: list[np.ndarray], target: np.ndarray, copies: np.ndarray | None = None, sparsity: float = 2e-4, rounds: int = 200
) -> tuple[np.ndarray, float]:
    """Weights of a logistic model with an L1 penalty, by accelerated proximal gradient steps.

    Row i has the features ``rows[i]`` and counts ``copies[i]`` times."""
    n = len(rows)
    copies = np.ones(n) if copies is None else np.asarray(copies, float)
    total = max(1.0, copies.sum())
    at = np.concatenate(rows) if n else np.empty(0, np.int32)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    # The gradient of a feature of so few documents never exceeds the penalty: its weight is 0.
    likely = np.bincount(at, weights=copies[owner], minlength=FEATURES)[at] > sparsity * total
    at, owner = at[likely], owner[likely]
    used, index = np.unique(at, return_inverse=True)
    w = np.zeros(len(used) + 1)
    v, momentum, rate = w.copy(), 1.0, 4.0 / max(1.0, copies[owner].sum() / total)
    mean = lambda p: np.append(np.bincount(index, weights=p[owner], minlength=len(used)), p.sum()) / total

    def loss(w):
        z = np.bincount(owner, weights=w[index], minlength=n) + w[-1]
        return float(copies @ (np.logaddexp(0, z) - target * z)) / total, z

    for _ in range(rounds):
        f, z = loss(v)
        g = mean(copies * (1 / (1 + np.exp(-z)) - target))
        while True:
            new = v - rate * g
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * sparsity, 0)
            step = new - v
            if loss(new)[0] <= f + g @ step + (step @ step) / (2 * rate) + 1e-12:
                break
            rate /= 2
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v = new + (momentum - 1) / following * (new - w)
        w, momentum, rate = new, following, rate * 1.1
    full = np.zeros(FEATURES)
    full[used] = w[:-1]
    return full, float(w[-1])


@dataclass
class QualityModel:
    """Posteriors of vote patterns and the linear scorer; ``at`` lists the weights that are not 0."""

    posterior: dict[int, float]
    at: np.ndarray
    weight: np.ndarray
    bias: float
    labeller_rates: dict[str, dict[str, float]]
    lexicon: frozenset[bytes] = frozenset()

    def dense(self) -> np.ndarray:
        w = np.zeros(FEATURES)
        w[self.at] = self.weight
        return w


def mine_lexicon(docs: DataFrame, labels: DataFrame, label_rows: int) -> frozenset[bytes]:
    """Words of toxic documents, from about ``label_rows`` labelled documents picked by a hash."""
    share = min(1.0, label_rows / max(1, labels.count()))
    picked = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = picked.where("quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").select("text", "toxic", "quality")

    def run(batches):
        toxic, clean = Counter(), Counter()
        texts = [0, 0]
        for batch in batches:
            for text, is_toxic, quality in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if is_toxic == 1 or quality == 1:
                    (toxic if is_toxic == 1 else clean).update(set(words_of(text or "")))
                    texts[int(is_toxic != 1)] += 1
        words = [*(toxic.keys() | clean.keys())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b"", *words], pa.binary()),
                pa.array([texts[0], *(toxic[w] for w in words)], pa.int64()),
                pa.array([texts[1], *(clean[w] for w in words)], pa.int64()),
            ],
            ["word", "toxic", "clean"],
        )

    seen = texts.mapInArrow(run, "word binary, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A word has at least LEXICON_LEAST documents of the sample, which bounds what comes back.
    found = seen.where((F.col("toxic") >= LEXICON_LEAST) & (F.col("toxic") > F.col("clean")) | (F.col("word") == F.lit(b""))).collect()
    texts = {bytes(r["word"]): (r["toxic"], r["clean"]) for r in found}
    n_toxic, n_clean = texts.pop(b"", (0, 0))
    return frozenset(w for w, (t, c) in texts.items() if t / (n_toxic + 1) >= LEXICON_RATIO * (c + 0.5) / (n_clean + 1))


def sampled(docs: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """``text, copies``: about ``rows`` distinct rows (id, text) picked by their hash, or all of fewer."""
    named = docs.select(F.xxhash64(F.col(id_col), "text", F.lit("sample")).alias("h"), "text")
    distinct = named.agg(F.approx_count_distinct("h")).first()[0]
    # The count is within a tenth or so.
    share = 1.0 if distinct <= 0.8 * rows else min(1.0, rows / distinct)
    picked = named.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return picked.groupBy("h").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("text", "copies")


def fit(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = 6000, label_rows: int = 12000, id_col: str = "doc_id") -> QualityModel:
    """Votes of all documents give the posteriors; about ``train_rows`` documents train the scorer,
    and about ``label_rows`` labels (doc_id, quality, toxic) the lexicon.

    Documents are picked by a hash of id and text, so copies of a text under other ids come in one by
    one, in proportion.  Rows of one id and one text are one row of the sample with their number as its
    weight, however many there are: what comes to the driver is bounded.  Where the table has fewer
    distinct rows than ``train_rows``, all are picked.
    """
    small_batches(docs.sparkSession)
    lexicon = frozenset() if labels is None else mine_lexicon(docs, labels, label_rows)

    def vote():
        return lambda batch: {"pattern": [votes(*style(v.as_py() or ""), lexicon) for v in batch.column(0)]}

    counted = map_arrow(docs.select("text"), vote, "pattern int").groupBy("pattern").count().collect()
    if not counted:
        return QualityModel({}, np.empty(0, int), np.empty(0), 0.0, {})
    counted.sort()
    patterns, counts = (np.array([r[i] for r in counted]) for i in (0, 1))
    _, rate, post = estimate(patterns, counts)
    posterior = {int(p): float(1 - q[0]) for p, q in zip(patterns, post)}

    def sample():
        def step(batch):
            out = [style(v.as_py() or "") for v in batch.column(0)]
            return {"pattern": [votes(*x, lexicon) for x in out], "at": [features(m, w) for m, w, _ in out], "copies": batch.column(1)}

        return step

    rows = map_arrow(sampled(docs, train_rows, id_col), sample, "pattern int, at array<int>, copies bigint").collect()
    rows.sort(key=lambda r: (r["pattern"], r["at"], r["copies"]))  # the order of arrival is not fixed
    weight, bias = fit_linear(
        [np.array(r["at"], np.int32) for r in rows], np.array([posterior[r["pattern"]] for r in rows]), np.array([r["copies"] for r in rows])
    )
    at = np.flatnonzero(weight)
    rates = {name: dict(zip(CLASSES, map(float, rate[:, i]))) for i, (name, _) in enumerate(LABELLERS)}
    return QualityModel(posterior, at, weight[at], bias, rates, lexicon)


def score_column(model: QualityModel):
    """A function from texts to (votes, posterior, score)."""
    weight = model.dense()

    def scored(texts):
        for t in texts:
            measures, words, insults = style(t)
            pattern = votes(measures, words, insults, model.lexicon)
            z = float(weight[features(measures, words)].sum()) + model.bias
            yield pattern, model.posterior.get(pattern, 0.0), float(1 / (1 + np.exp(-z)))

    return scored


def quality_scores(docs: DataFrame, labels: DataFrame | None = None, limit: float = 0.5, id_col: str = "doc_id", train_rows: int = 6000) -> DataFrame:
    """Rows ``id_col, labellers, posterior, score, kept``: the chance of being junk or toxic, by the
    labellers that spoke and by the scorer; ``kept`` if both are under ``limit``.

    Null and empty texts have no words and no style: no labeller speaks, no feature is present, and
    their score is that of the bias.  Repeated rows and rows of a null id are scored each for itself; an
    empty table gives an empty table; other columns are ignored.
    """
    model = fit(docs, labels, train_rows, id_col=id_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        scored = score_column(model)

        def step(batch):
            rows = list(scored(v.as_py() or "" for v in batch.column(1)))
            return {
                id_col: batch.column(0),
                "labellers": [",".join(n for i, (n, _) in enumerate(LABELLERS) if p >> i & 1) for p, _, _ in rows],
                "posterior": [q for _, q, _ in rows],
                "score": [s for _, _, s in rows],
                "kept": [max(q, s) < limit for _, q, s in rows],
            }

        return step

    return map_arrow(
        docs.select(id_col, "text"), make, f"`{id_col}` {kind}, labellers string, posterior double, score double, kept boolean"
    )


def quality_filter(docs: DataFrame, labels: DataFrame | None = None, limit: float = 0.5, train_rows: int = 6000) -> DataFrame:
    """The documents that :func:`quality_scores` keeps, with all their columns."""
    model = fit(docs, labels, train_rows)
    place = docs.columns.index("text")

    def run(batches):
        scored = score_column(model)
        for batch in batches:
            keep = [max(q, s) < limit for _, q, s in scored(v.as_py() or "" for v in batch.column(place))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
