"""Product names in a text, scored once for each distinct text of a batch.

The rules are those of :mod:`haggle.functions.text` (``name_parts``, ``name_score``, ``clean_name``), which
serve single columns.  Reducing fragments scores every text of every fragment, and texts of one page and
one shop repeat: as expressions, that was four fifths of a crawl's time."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AMOUNT, MODEL_MARKS, OPTION_WORDS, PRICE_LABELS, SPEC_LABELS, UI_TEXTS

#: Runs of so many parts are joined at most.
LONGEST_RUN = 6
USELESS = -50.0
_bare = re.compile(rf"{AMOUNT}원?")
_labelled = re.compile(rf"(?:{PRICE_LABELS})\s*[:：]?\s*{AMOUNT}(?:\s*원)?|[0-9]+\s*[몰위]")
_spec = re.compile(rf"(?ai:{SPEC_LABELS})\s*[:：]")
_marks = re.compile(f"(?ai:{MODEL_MARKS.removeprefix('(?i)')})")
_letters = re.compile("[가-힣A-Za-z]")
_digits = re.compile("[0-9]")


def _option_only(low: str) -> bool:
    return any(w in low for w in OPTION_WORDS) and not _digits.search(low) and sum(map(bool, re.split(r"\s+|,", low))) <= 4


def usable(text: str | None) -> str | None:
    """The text with its white space collapsed, or None if it names nothing."""
    name = " ".join((text or "").split())
    if len(name) < 3:
        return None
    low = name.lower()
    no_name = low in UI_TEXTS or _labelled.fullmatch(name) or _spec.match(name) or _option_only(low)
    if not no_name and len(_digits.findall(name)) >= 4:
        no_name = _bare.fullmatch("".join(name.split()))
    return None if no_name else name


def parts(text: str) -> list[tuple[str, bool]]:
    """(name, whether it is joined): the parts between slashes, then runs of two to six of them."""
    good = [n for n in map(usable, text.split("/")) if n]
    names = [(n, False) for n in good]
    if len(good) > 1:
        runs = (usable(" ".join(good[a : a + n])) for a in range(len(good) - 1) for n in range(2, min(LONGEST_RUN, len(good) - a) + 1))
        names += [(n, True) for n in runs if n]
    return list(dict.fromkeys(names))


def terms(query: str | None) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w.lower() for w in (query or "").split() if len(w) >= 2))


def points(name: str, wanted: tuple[str, ...]) -> float:
    low = name.lower()
    found = 2.0 * bool(_letters.search(name)) + bool(_digits.search(name)) + 2.0 * bool(_marks.search(name)) + 2.0 * (len(name.split()) >= 3)
    found += 3.0 * sum(t in low for t in wanted) - 50.0 * bool(_option_only(low) or _spec.match(name)) - 100.0 * (low in UI_TEXTS)
    return found + min(len(name), 120) / 120.0


@lru_cache(1 << 16)
def best(text: str, query: str | None) -> tuple:
    """clean, then (score, place, name) of the best name, and of the best when joined names lose two points."""
    wanted = terms(query)
    scored = [(points(n, wanted), -i, n, joined) for i, (n, joined) in enumerate(parts(text))]
    scored = [s for s in scored if s[0] > USELESS]
    plain = max((s[:3] for s in scored), default=(None,) * 3)
    late = max(((s - 2.0 * joined, i, n) for s, i, n, joined in scored), default=(None,) * 3)
    return usable(text), plain, late


NAMED = "struct<clean string, plain struct<score double, place int, name string>, late struct<score double, place int, name string>>"
_ONE = pa.struct([("score", pa.float64()), ("place", pa.int32()), ("name", pa.string())])


def _names(text: pa.Array, query: pa.Array) -> pa.Array:
    """Distinct pairs of the batch are worked out, and all rows take theirs."""
    pair = pa.table({"t": pc.dictionary_encode(text.cast(pa.string())).indices, "q": pc.dictionary_encode(query.cast(pa.string())).indices, "i": pa.array(range(len(text)))})
    ids = pc.add(pc.multiply(pc.fill_null(pair["t"], -1).cast(pa.int64()), 1 << 31), pc.fill_null(pair["q"], -1).cast(pa.int64()))
    encoded = pc.dictionary_encode(ids).combine_chunks() if isinstance(ids, pa.ChunkedArray) else pc.dictionary_encode(ids)
    place = pa.table({"k": encoded.indices, "i": pair["i"]}).group_by("k").aggregate([("i", "min")]).sort_by("k")["i_min"].to_pylist()
    rows = [best(text[i].as_py(), query[i].as_py()) if text[i].is_valid else (None, (None,) * 3, (None,) * 3) for i in place]
    struct = lambda values: pa.StructArray.from_arrays([pa.array([v[k] for v in values], f.type) for k, f in enumerate(_ONE)], fields=list(_ONE))
    distinct = pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), struct([r[1] for r in rows]), struct([r[2] for r in rows])], ["clean", "plain", "late"]
    )
    return distinct.take(encoded.indices)


def names(text: Column, query: Column) -> Column:
    """``struct<clean, plain, late>`` of each text (see :func:`best`); all null for a null text."""
    return F.arrow_udf(_names, NAMED)(text, query)
