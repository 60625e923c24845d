"""License scans over a positional index of rare words.

The template texts are indexed by word: each word's postings are (template, position).  A pass
over the corpus counts in how many files each licence word stands, which gives its IDF.  A file's
highest-IDF licence words are looked up first; the postings of a word at place p vote for the
template start p - position, and starts that several words agree on are verified: the template's
mandatory key phrases must stand at their places behind the start.  A verified start is scored by the
share of the template's words found in place.  Since the two rarest words of every key phrase are
always looked up, a start is verified wherever the key phrases stand.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ("apache license version 2 0",),
    ),
    Template(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    Template(
        "gpl-2.0",
        "this work is licensed under the gnu general public license version 2",
        ("gnu general public license version 2",),
    ),
    Template("mit-text", "released under the mit license", ("under the mit license",)),
    Template(
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge",),
    ),
    Template("cc-by-4.0", "this work is licensed under cc by 4 0", ("cc by 4 0",)),
    Template(
        "cc-by-4.0",
        "licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use in source and binary forms",),
    ),
)

#: Words are runs of 0-9, a-z and all bytes above 7F, after A-Z became a-z.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


class Index:
    """Positional postings of the template words; ``frequency`` is their document frequency."""

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES, frequency: dict[bytes, int] | None = None, files: int = 0):
        self.templates = []
        for t in templates:
            words, keys = words_of(t.text), [words_of(k) for k in t.keys]
            spots = [next((i for i in range(len(words)) if words[i : i + len(k)] == k), None) for k in keys]
            if not keys or None in spots or any(len(set(k)) < 2 for k in keys):
                raise ValueError(f"a key phrase has two words or more and stands in its template: {t.label}")
            self.templates.append((t.label, words, list(zip(spots, keys))))
        self.base = [(label, words_of(p)) for p, label in base.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words, _) in enumerate(self.templates):
            for i, w in enumerate(words):
                self.postings[w].append((k, i))
        frequency = frequency or {}
        self.vocabulary = frozenset(self.postings) | {w for _, p in self.base for w in p}
        self.idf = {w: math.log((files + 1) / (frequency.get(w, 0) + 1)) for w in self.vocabulary}
        # A template is looked for by its rarest words, in as many as its key phrases have at least, and
        # by the two rarest of each key phrase, so that a file with a key phrase always has two votes.
        rarest = lambda words, n: set(sorted(set(words), key=lambda w: (-self.idf[w], w))[:n])
        self.rare = [rarest(words, max(2, len(keys[0][1]) // 2)).union(*(rarest(k, 2) for _, k in keys)) for _, words, keys in self.templates]
        self.anchor = [(label, p, min(range(len(p)), key=lambda i: (-self.idf[p[i]], i))) for label, p in self.base]
        self.wanted = set().union(*self.rare) | {p[i] for _, p, i in self.anchor}

    def places(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Positions of the rare words that the file has, rarest first."""
        found: dict[bytes, list[int]] = {}
        for w in sorted(self.wanted.intersection(words), key=lambda w: (-self.idf[w], w)):
            at, spots = -1, []
            try:
                while True:
                    at = words.index(w, at + 1)
                    spots.append(at)
            except ValueError:
                found[w] = spots
        return found

    def scan(self, text: str) -> dict:
        words = words_of(text)
        spots = self.places(words)
        base: list[tuple[int, str]] = []
        for label, phrase, i in self.anchor:
            base += [
                (p - i, label) for p in spots.get(phrase[i], ()) if p >= i and words[p - i : p - i + len(phrase)] == phrase
            ]
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for w, places in spots.items():
            for k, i in self.postings.get(w, ()):
                if w in self.rare[k]:
                    for p in places:
                        votes[k, p - i] += 1
        best, matches = 0.0, []
        for (k, start), n in votes.items():
            label, template, keys = self.templates[k]
            if n < 2 or not all(start + i >= 0 and words[start + i : start + i + len(key)] == key for i, key in keys):
                continue
            hit = sum(1 for i, w in enumerate(template) if 0 <= start + i < len(words) and words[start + i] == w)
            best = max(best, hit / len(template))
            matches.append((start, start + len(template), label, hit / len(template)))
        return {"words": len(words), "base": sorted(base), "matches": sorted(matches), "score": best if matches else 0.5 * bool(base)}


def licence_word_counts(docs: DataFrame, index: Index) -> tuple[dict[bytes, int], int]:
    """In how many files each licence word stands (a table as long as the templates' vocabulary)."""
    listed = sorted(index.vocabulary)

    def make():
        def step(batch):
            count = dict.fromkeys(listed, 0)
            n = 0
            for value in batch.column(0):
                n += 1
                for w in index.vocabulary.intersection(words_of(value.as_py() or "")):
                    count[w] += 1
            return {"word": [*listed, b""], "n": [*count.values(), n]}

        return step

    counts = map_arrow(docs.select("text"), make, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in counts.collect()}
    return found, found.pop(b"", 0)


def license_scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """Rows ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``score`` is the best template's share of words in place, 0.5 where only a base phrase stands,
    else 0.  ``spans`` lists the verified templates as (first word, word after the last, label).
    A span may begin before the text (a negative start) or end behind it where only part of a template
    stands there.  Null and empty texts have no words, no labels ('') and score 0; rows of a null or
    repeated id are scanned each for itself; an empty table gives an empty table; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    frequency, files = licence_word_counts(docs, Index(templates))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        index = Index(templates, BASE_PHRASES, frequency, files)

        def step(batch):
            rows = [index.scan(v.as_py() or "") for v in batch.column(1)]
            labels = [{x for _, x in r["base"]} for r in rows]
            return {
                id_col: batch.column(0),
                "n_words": [r["words"] for r in rows],
                "n_base": [len(r["base"]) for r in rows],
                "first_word": [r["base"][0][0] if r["base"] else None for r in rows],
                "last_word": [r["base"][-1][0] if r["base"] else None for r in rows],
                "base_labels": [",".join(sorted(x)) for x in labels],
                "labels": [",".join(sorted(x | {m[2] for m in r["matches"]})) for x, r in zip(labels, rows)],
                "score": [r["score"] for r in rows],
                "spans": [[{"start": m[0], "end": m[1], "label": m[2]} for m in r["matches"]] for r in rows],
            }

        return step

    return map_arrow(
        docs.select(id_col, "text"),
        make,
        f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<start:bigint,end:bigint,label:string>>",
    )
