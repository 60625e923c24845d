"""Price parsers.  Their rules differ on purpose; none replaces another."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, contains_any, squash

# Markers of offers without a price, and the amount patterns.
NO_PRICE_MARKS = ("무료나눔", "나눔", "가격제안", "가격 제안", "협의", "문의")
WON = r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?U:[\s\x1c-\x1f])*원"
GROUPED = r"([0-9]{1,3}(?:,[0-9]{3})+)"
BLOCK_PRICE = r"(무료나눔|가격(?U:\s)*제안|가격제안|[0-9](?U:[0-9,\s])*원)"


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def _whole(digits: Column) -> Column:
    return F.regexp_replace(digits, "[^0-9]+", "").try_cast("bigint")


def _amount(text: Column, mark: str, pattern: str) -> Column:
    """The last amount, of digits and commas, of a text that has the pattern's mark; only such a text is searched."""
    return F.when(text.contains(mark), F.replace(_last(text, pattern), F.lit(","), F.lit("")).try_cast("bigint"))


def _no_price(text: Column) -> Column:
    """Whether a no-price marker stands in the text once its white space is collapsed; only those of two words need that."""
    spaced = [m.split(" ") for m in NO_PRICE_MARKS if " " in m]
    found = contains_any(text, [m for m in NO_PRICE_MARKS if " " not in m])
    for words in spaced:
        found = found | F.when(reduce(and_, (text.contains(w) for w in words)), squash(text).contains(" ".join(words))).otherwise(False)
    return found


def parse_price(value: Column, structured: bool = False) -> Column:
    """The last won amount, else the last grouped number, of a text without a no-price marker;
    a structured text may also be all digits.

    White space stands only before the won sign, where the pattern takes any, so texts are searched as they are."""
    text = value.cast("string")
    found = F.coalesce(_amount(text, "원", WON), _amount(text, ",", GROUPED))
    if structured:
        found = F.coalesce(found, F.when(text.rlike(rf"\A{WS}*+[0-9]++{WS}*+\z"), squash(text).try_cast("bigint")))
    return F.when(~_no_price(text), found)


def structured_number(value: Column) -> Column:
    """A number given as a number: negative is null, fractions are cut off."""
    return F.when(value >= 0, value.try_cast("bigint"))


def lenient_number(value: Column) -> Column:
    """All but digits and points deleted, then read as a double; null if that is no number."""
    return F.regexp_replace(value.cast("string"), "[^0-9.]+", "").try_cast("double")


def digits_number(value: Column) -> Column:
    """All but digits deleted."""
    return _whole(value.cast("string"))


def strict_number(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def positive_number(value: Column) -> Column:
    """A text of digits and commas above 0."""
    whole = F.when(F.trim(F.replace(value, F.lit(","), F.lit(""))).rlike(r"\A[0-9]+\z"), F.replace(value, F.lit(","), F.lit("")).try_cast("bigint"))
    return F.when(whole > 0, whole)


def block_price(text: Column) -> Column:
    """The last price-like phrase of a page block."""
    return F.trim(_last(text, BLOCK_PRICE))
