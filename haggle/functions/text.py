"""Text, name and condition functions, as Column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str methods see it; Java's class leaves out 1C-1F.
WS = r"(?U)[\s\x1c-\x1f]"

# Texts that are never names, option words, markers and patterns.
UI_TEXTS = (
    "new 새로워진 상품비교 기능",
    "을 이용해보세요.",
    "닫기",
    "혜택 최저가",
    "가격정보 더보기",
    "vs상품비교",
)
OPTION_WORDS = ("티타늄", "블랙", "화이트", "블루", "실버", "그레이", "그린", "옐로우", "핑크")
BAD_NAMES = ("요금할인(선택약정)", "단말할인(공통지원)", "혜택 최저가")
USED = ("중고", "S등급", "A등급", "최상급")
REFURBISHED = ("리퍼", "refurbished", "renewed")
NEW = ("새상품", "미개봉", "신품", "자급제")
AMOUNT = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"
PRICE_LABELS = "출시가|판매가|가격|정가|할인가|최저가|혜택가"
SPEC_LABELS = "후면|전면|화면|CPU|GPU|RAM|메모리|배터리|OS"
MODEL_MARKS = "(?i)GB|TB|자급제|S[0-9]+|울트라|Ultra"
FREE_SHIPPING = ("무료배송", "배송비 무료")


def squash(value: Column) -> Column:
    """White space collapsed and trimmed; blank becomes null.

    Most texts are words of ASCII or Hangul with one blank between: only others are rewritten."""
    text = value.cast("string")
    odd = text.contains("  ") | text.rlike("[^ -~가-힣]")
    one_line = F.when(odd, F.regexp_replace(text, WS + "+", " ")).otherwise(text)
    return F.nullif(F.trim(one_line), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once.  Inside lambdas Spark shares no common
    subexpressions, so a value used several times there is bound to a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def present(value: Column) -> Column:
    """Null where the text is null or empty."""
    return F.nullif(value, F.lit(""))


@F.pandas_udf(StringType())
def casefold(value: pd.Series) -> pd.Series:
    """Full case folding, which Spark's lower() is not."""
    return value.str.casefold()


def fold_text(value: Column) -> Column:
    """Collapsed, trimmed and case-folded; only texts beyond ASCII go to the UDF."""
    text = F.trim(F.regexp_replace(value, WS + "+", " "))
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, F.lower(text)).otherwise(casefold(F.when(~plain, text)))


def contains_any(value: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, (value.contains(m) for m in marks), F.lit(False))


# -- conditions ---------------------------------------------------------------------------------


def condition_marks(text: Column) -> tuple[Column, Column, Column]:
    """Whether a text speaks of used, of refurbished (A-Z as a-z) and of new goods."""
    return contains_any(text, USED), contains_any(F.lower(text), REFURBISHED), contains_any(text, NEW)


def condition_by(used: Column, refurbished: Column, new: Column, default: Column) -> Column:
    """Used before refurbished before new; blank default reads as unknown."""
    return F.when(used, "used").when(refurbished, "refurbished").when(new, "new").otherwise(F.coalesce(present(default), F.lit("unknown")))


def condition_of(text: Column, default: Column) -> Column:
    return condition_by(*condition_marks(text), default)


def marketplace_condition(value: Column) -> Column:
    """A marketplace's condition text; 'new' is looked for first, so 'Renewed' reads as new."""
    low = F.lower(value)
    return (
        F.when(low.contains("new"), "new")
        .when(low.contains("used") | low.contains("pre-owned"), "used")
        .when(low.contains("refurbished"), "refurbished")
        .otherwise("unknown")
    )


# -- names ----------------------------------------------------------------------------------------


def option_only(name: Column) -> Column:
    """At most four words, one of them a colour, and no digit."""
    low = F.lower(name)
    words = F.filter(F.split(low, WS + "+|,"), lambda w: w != "")
    return contains_any(low, OPTION_WORDS) & (F.size(words) <= 4) & ~low.rlike("[0-9]")


def bare_price(name: Column) -> Column:
    """Nothing but an amount of four digits or more."""
    tight = F.regexp_replace(name, WS + "+", "")
    digits = F.length(F.regexp_replace(tight, "[^0-9]", ""))
    return (digits >= 4) & tight.rlike(rf"\A{AMOUNT}원?\z")


def spec_line(name: Column) -> Column:
    return name.rlike(rf"(?i)\A(?:{SPEC_LABELS})(?U:\s)*[:：]")


def clean_name(value: Column) -> Column:
    """A usable product name, or null."""
    return _usable_name(squash(value))


def _usable_name(name: Column) -> Column:
    unusable = (
        F.lower(name).isin(*UI_TEXTS)
        | bare_price(name)
        | name.rlike(rf"\A(?:{PRICE_LABELS})(?U:\s)*[:：]?(?U:\s)*{AMOUNT}(?:(?U:\s)*원)?\z")
        | name.rlike(r"\A[0-9]+(?U:\s)*[몰위]\z")
        | spec_line(name)
        | option_only(name)
        | (F.length(name) < 3)
    )
    return F.when(~unusable, name)


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of two characters or more; a null query has none."""
    words = F.split(F.coalesce(query, F.lit("")), WS + "+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 2), F.lower))


def name_score(name: Column, terms: Column) -> Column:
    low = F.lower(name)
    points = (
        F.when(name.rlike("[가-힣A-Za-z]"), 2.0).otherwise(0.0)
        + F.when(name.rlike("[0-9]"), 1.0).otherwise(0.0)
        + F.when(name.rlike(MODEL_MARKS), 2.0).otherwise(0.0)
        + F.when(F.size(F.split(name, WS + "+")) >= 3, 2.0).otherwise(0.0)
        + F.lit(3.0) * F.size(F.filter(terms, lambda t: F.contains(low, t)))
        - F.when(option_only(name) | spec_line(name), 50.0).otherwise(0.0)
        - F.when(low.isin(*UI_TEXTS), 100.0).otherwise(0.0)
    )
    return points + F.least(F.length(name), F.lit(120)) / F.lit(120.0)


def name_parts(text: Column) -> Column:
    """``array<struct<name, joined>>``: the cleaned text, or its parts between slashes, then the
    runs of two to six parts joined by blanks; each pair once, in order."""
    slashed = text.contains("/")
    split = F.filter(
        F.transform(F.split(text, "/"), lambda p: F.regexp_replace(p, rf"\A{WS}+|{WS}+\z", "")), lambda p: p != ""
    )
    bound = lambda p: let(squash(p), _usable_name)
    one = lambda flag: lambda p: F.struct(p.alias("name"), F.lit(flag).alias("joined"))

    def with_runs(cleaned: Column) -> Column:
        runs = F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(cleaned) - 1),
                lambda a: F.transform(
                    F.sequence(F.lit(2), F.least(F.lit(6), F.size(cleaned) - a + 1)), lambda n: F.array_join(F.slice(cleaned, a, n), " ")
                ),
            )
        )
        joined = F.filter(F.transform(runs, bound), lambda r: r.isNotNull())
        plain = F.transform(cleaned, one(False))
        # Without a slash the text is its own only part; it comes twice and stays once.
        return F.when(slashed & (F.size(cleaned) > 1), F.concat(plain, F.transform(joined, one(True)))).otherwise(plain)

    return F.array_distinct(let(F.filter(F.transform(split, bound), lambda p: p.isNotNull()), with_runs))


# -- shipping ---------------------------------------------------------------------------------------


def shipping_from_page(text: Column) -> Column:
    """The fee that a page's text names: 0 for free phrases, else the amount after the label."""
    amount = F.regexp_extract(text, r"배송비(?U:\s)*([0-9,]+)(?U:\s)*원", 1)
    return F.when(contains_any(text, FREE_SHIPPING), 0.0).otherwise(F.regexp_replace(amount, "[^0-9.]", "").try_cast("double"))


def shipping_from_field(value: Column, english: bool = True) -> Column:
    """The fee of a shipping field; ``english`` also reads 'free' as 0."""
    free = value.contains("무료")
    if english:
        free = free | F.lower(value).contains("free")
    return F.when(free, 0.0).otherwise(F.regexp_replace(value, "[^0-9.]", "").try_cast("double"))
