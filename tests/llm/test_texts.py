"""Chat formatting, encoding, token counts and license scans against brute force and the library."""

import hashlib
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haggle.llm import bpe, chat, license_scan, token_count
from haggle.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "\n\n  x", "a" * 70000, "ab" * 20000, "  " * 9000, "don't we'll I'M 'S", "x<|endoftext|>y<|endoftext|>", "<|endoftext|>", "é" * 400, "日本語 テキスト 한국어", "🎉🎉 ok‍",
    "1²³ ½ ٣", "\x00\x01\x85\xa0  z", "!!??--", "Ünïcödé ªº",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def odd_texts():
    rng = random.Random(9)
    pool = "ab the \n\t'sd 12é한ß🎉<|endoftext|> aaaa    x_-!?"
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(300)]


def test_encoding_and_decoding_agree_with_the_library(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe.bpe_encode(docs)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: r.text for r in bpe.bpe_decode(encoded).collect()}
    digests = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(docs).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want
        assert back[i] == (t or "") == library.decode(want, skip_special_tokens=False)
        assert digests[i] == (len(want), sha(",".join(map(str, want))), sha(t or ""))
    assert bpe.bpe_decode(spark.createDataFrame([(1, None), (1, [])], "doc_id long, ids array<int>")).select("text").distinct().collect()[0][0] == ""
    assert bpe.bpe_round_trip(docs.limit(0)).count() == 0


def test_memo_forgets_but_stays_right():
    memo = bpe.Memo(lambda k: k * 2, limit=3)
    assert [memo[str(k % 7)] for k in range(200)] == [str(k % 7) * 2 for k in range(200)]
    assert len(memo) <= 3 and len(memo.old) <= 3
    long = "x" * (bpe.LONG_PIECE + 1)
    assert memo[long] == long * 2 and long not in memo and long not in memo.old


def test_token_counts_agree_with_the_library(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, "twice", 5), (None, "no id", 5)], "doc_id long, text string, n_tokens int")
    got = token_count.token_counts(docs, limit=40).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] if r.doc_id else None
        if r.doc_id:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((t or "").encode()), n > 40)
    assert token_count.token_counts(docs.limit(0)).count() == 0


def test_proven_set_is_what_encodes_alone(library):
    counter = token_count.counter(bpe.tokenizer_path(), token_count.proven(bpe.tokenizer_path()))
    rng = random.Random(1)
    for raw in rng.sample(sorted(counter.proven), 500):
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if counter.bpe.pieces(text) == [text]:
            assert len(library.encode(text, add_special_tokens=False).ids) == 1


# -- chat ------------------------------------------------------------------------------------------------


def test_chat_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op1_chat_format"]).df()
    got = QUERIES["op1_chat_format"](spark, SF).toPandas()
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values))
    assert key(got) == key(want)


def test_chat_round_trip_of_odd_turns(spark):
    control = "<|im_end|>\n<|im_start|>assistant\nok<|im_sep|>\\<\\|"
    turns = [
        (1, 0, "user", "a"), (1, 1, "user", control), (1, 2, "assistant", None), (1, 2, "assistant", "x\\"), (1, 3, "assistant", control), (2, 0, "ro\nle<|\\n", "t"), (2, None, None, "first"),
        (None, 1, "user", "lost"), (3, 0, "assistant", ""), (4, 0, "assistant", "long " * 30000), (5, 0, "assistant", "\n"), (5, 0, "assistant", "\n"),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "a"), ("user", control), ("assistant", ""), ("assistant", "x\\"), ("assistant", control)]
    assert back[1].loss_text == "x\\" + control
    assert back[1].formatted.count("<|im_start|>") == 2 and back[1].formatted.count("<|im_sep|>") == 3
    assert [(t.role, t.text) for t in back[2].turns] == [("", "first"), ("ro\nle<|\\n", "t")]
    assert back[None].turns[0].text == "lost" and back[3].loss_text == "" and back[4].loss_text == "long " * 30000
    assert back[5].loss_text == "\n\n"
    spans = chat.format_chats(df).where("conv_id = 1").first()
    shown = [spans.formatted[s.start : s.start + s.length] for s in spans.loss_spans]
    assert [s.replace("\\|", "|").replace("\\\\", "\\") for s in shown][0:2] == ["", "x\\"] and len(shown) == 3
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_loss_spans_stand_where_they_say(spark):
    rng = random.Random(2)
    turns = [(c, i, rng.choice(["user", "assistant"]), rng.choice(["", "é|", "<|x\\", "long text"])) for c in range(20) for i in range(rng.randrange(1, 40))]
    for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect():
        said = [t[3] for t in turns if t[0] == r.conv_id and t[2] == "assistant"]
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [t.replace("\\", "\\\\").replace("<|", "<\\|") for t in said]


def test_chat_work_grows_with_the_turns(spark):
    """Twenty thousand turns are read back exactly, in one exchange, in about four times the time of five thousand."""
    took = []
    for n in (5000, 5000, 20000):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <|x "), "id").alias("text"))
        digests = chat.chat_digests(turns)
        started = time.perf_counter()
        row = digests.first()
        took.append(time.perf_counter() - started)
        said = [("user" if i % 3 == 0 else "assistant", f"text <|x {i}") for i in range(n)]
        assert (row.n_turns, row.turns_sha256) == (n, sha("".join(f"{r}\n{t}\n" for r, t in said)))
        assert row.loss_sha256 == sha("".join(t for r, t in said if r == "assistant"))
    assert took[2] < 8 * took[1] + 1
    assert digests._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


# -- licenses --------------------------------------------------------------------------------------------


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted(
        (i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    )
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(2)
    bits = ["MIT License", "mit", "license", "Apache License,", "GNU General Public License", "gnu general", "CC-BY", "cc", "by", "über", "x", "\n", "-", "Version 2.0", "under the"]
    texts = ODD + [" ".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License", "Apache License " * 20000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    n = len(texts)
    assert (got[n - 4].labels, got[n - 4].score) == ("apache,apache-2.0", 1.0)
    assert (got[n - 3].labels, got[n - 2].labels) == ("gpl,gpl-3.0", "mit,mit-text")
    assert [tuple(s) for s in got[n - 3].spans] == [(0, 12, "gpl-3.0")]
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_license_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(1, "MIT mit"), (2, "mit license"), (3, None)], "doc_id long, text string")
    counts, files = license_scan.licence_word_counts(docs, license_scan.Index())
    assert files == 3 and counts[b"mit"] == 2 and counts[b"license"] == 1 and counts[b"apache"] == 0


def test_registered_queries_are_complete():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(i) for i in range(1, 14)]


def test_all_columns_of_contracts(spark):
    shape = {
        "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op5_embed_dup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op7_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        "op8_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
        "op9_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op10_token_count": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op11_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
        "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
        "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    }
    for name, want in shape.items():
        df = QUERIES[name](spark, SF)
        assert [f"{c} {k}" for c, k in df.dtypes] == want.split(", "), name


def test_a_key_phrase_is_found_whatever_the_counts():
    for rare in (["released", "license"], ["mit", "license"], ["under", "the"], ["released"], []):
        counts = {w: 0 if w.decode() in rare else 50 for w in license_scan.Index().vocabulary}
        index = license_scan.Index(frequency=counts, files=100)
        for t in license_scan.TEMPLATES:
            for key in t.keys:
                assert t.label in {m[2] for m in index.scan(f"some words {key} and more")["matches"]}, (rare, t.label)


def test_license_labels_and_scores_match_brute_force(spark):
    rng = random.Random(4)
    bits = [t.text for t in license_scan.TEMPLATES] + [k for t in license_scan.TEMPLATES for k in t.keys] + ["mit license", "cc by", "under the", "x", "version", "2 0"]

    def made():
        words = " ".join(rng.choice(bits) for _ in range(rng.randrange(6))).split()
        for _ in range(rng.randrange(4)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(["the", "x", "license", "by"])
        return " ".join(words[rng.randrange(3) :])

    texts = [made() for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (None, texts[7]), (None, None)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))

    def brute(text):
        words = (text or "").split()
        labels, score = set(filter(None, brute_base(text)[4].split(","))), 0.0
        if labels:
            score = 0.5
        shares = []
        for t in license_scan.TEMPLATES:
            whole, key = t.text.split(), t.keys[0].split()
            at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
            for p in range(len(words)):
                if words[p : p + len(key)] == key:
                    labels.add(t.label)
                    shares.append(sum(0 <= p - at + i < len(words) and words[p - at + i] == w for i, w in enumerate(whole)) / len(whole))
        return ",".join(sorted(labels)), max(shares, default=score)

    assert sorted((str(r.doc_id), r.labels, r.score) for r in got.collect()) == sorted((str(d), *brute(t)) for d, t in rows)


def test_license_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op8_license_scan"]).df()
    got = QUERIES["op8_license_scan"](spark, SF).toPandas()

    def rows(d):
        shown = lambda v: v if isinstance(v, str) else None if pd.isna(v) else float(v)
        return sorted(str([shown(v) for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())

    assert rows(got) == rows(want)
