"""URL filters by a bit-parallel wildcard automaton.

Every rule and glob is a pattern over a canonical URL: ``.host/path?query``, the host in lower case
with a dot before it, without scheme and fragment.  All patterns lie side by side in one Shift-And mask
of as many 64-bit words as they need, and one pass over the bytes of a URL moves all of them:

    state = ((state << 1) & step[byte]) | (state & loop[byte])

``step[byte]`` has the places that a byte may enter, ``loop[byte]`` those that hold a wildcard, which a
byte may stay in.  The URLs of a batch move together, one byte of each at a time.

In a pattern ``*`` is any run of bytes without ``/`` and ``?``, so it stays inside a host or a part of a
path; ``**`` is any run; all else stands for itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer URLs are followed one by one, in one big integer each.
LONG_URL = 4096
#: Words of state that move together; it bounds a worker's memory.
STATE_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and what the path starts with."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> tuple[str, ...]:
        return ("*", "." + self.host + self.path, "**")


# The rules of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: What is blocked where no rule fits: hosts and files of advertising, gambling, pills and the like.
BLOCK_GLOBS = (
    "*casino**", "*.free-bets.**", "*.cheap-pills.**", "*.spam-*.**", "*.ads-*.**", "*.ads.**", "*.adult-*.**", "*.porn**", "*.tracker.**", "**/wp-login.php**", "**.exe",
)


def glob_pattern(glob: str) -> tuple[str, ...]:
    """The literals and wildcards of a glob; more than two stars are ``**`` too."""
    return tuple("**" if t.startswith("**") else t for t in re.findall(r"\*+|[^*]+", glob))


class Automaton:
    """All patterns in one mask; a pattern matches a whole URL."""

    def __init__(self, patterns: Sequence[tuple[str, ...]]):
        bit, start, anywhere, inside = 0, 0, 0, 0
        step = [0] * 256
        self.ends: list[int] = []
        for pattern in patterns:
            start |= 1 << bit
            for token in pattern:
                if token == "**":
                    anywhere |= 1 << bit
                elif token == "*":
                    inside |= 1 << bit
                else:
                    for byte in token.encode():
                        bit += 1
                        step[byte] |= 1 << bit
            self.ends.append(bit)
            # No byte enters the next pattern's first place, so patterns do not run into each other.
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start, self.step = start, step
        self.loop = [anywhere | (0 if byte in b"/?" else inside) for byte in range(256)]
        self._start, self._step, self._loop = self._packed([start])[0], self._packed(step), self._packed(self.loop)

    def _packed(self, masks: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(m.to_bytes(8 * self.words, "little") for m in masks), "<u8").reshape(len(masks), self.words)

    def follow(self, url: bytes) -> int:
        """The state behind one URL, as one integer."""
        state, step, loop = self.start, self.step, self.loop
        for byte in url:
            state = ((state << 1) & step[byte]) | (state & loop[byte])
        return state

    def states(self, urls: pa.Array) -> np.ndarray:
        """The states behind all URLs of an array without nulls, ``words`` words for each."""
        urls = urls.cast(pa.large_binary())
        _, offsets, data = urls.buffers()
        bounds = np.frombuffer(offsets, np.int64)[urls.offset : urls.offset + len(urls) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        length = np.diff(bounds)
        out = np.empty((len(urls), self.words), np.uint64)
        for i in np.flatnonzero(length > LONG_URL):
            out[i] = self._packed([self.follow(data[bounds[i] : bounds[i + 1]].tobytes())])[0]
        short = np.flatnonzero(length <= LONG_URL)
        # The longest first: those that have a byte at a place stand together at the front.
        short = short[np.argsort(-length[short], kind="stable")]
        rows = max(1, STATE_WORDS // self.words)
        for part in (short[i : i + rows] for i in range(0, len(short), rows)):
            state = np.tile(self._start, (len(part), 1))
            long, first = length[part], bounds[:-1][part]
            for place in range(int(long.max(initial=0))):
                n = int(np.searchsorted(-long, -place, side="left"))
                byte = data[first[:n] + place]
                moved = state[:n] << np.uint64(1)
                moved[:, 1:] |= state[:n, :-1] >> np.uint64(63)
                state[:n] = (moved & self._step[byte]) | (state[:n] & self._loop[byte])
            out[part] = state
        return out

    def matches(self, states: np.ndarray, pattern: int) -> np.ndarray:
        word, bit = divmod(self.ends[pattern], 64)
        return (states[:, word] >> np.uint64(bit)) & np.uint64(1) == 1


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else ''."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else ''."""
    return F.regexp_extract(_behind_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """What the patterns see: ``.host/path?query``; '' where there is no host to speak of."""
    query = F.regexp_extract(_behind_scheme(url), r"\A[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("."), host_of(url), path_of(url), query)).otherwise(F.lit(""))


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def verdicts(rules: Sequence[Rule], globs: Sequence[str]):
    """A UDF: the place of the longest fitting rule; else ``len(rules)`` if a glob blocks the URL; else -1."""
    for rule in rules:
        if not rule.path.startswith("/") or re.search(r"[?#]", rule.text) or "/" in rule.host or rule.action not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks a host and a path that begins with a slash: {rule}")
    patterns = [r.pattern for r in rules] + [glob_pattern(g) for g in globs]
    # The longest last, so that it is written over the others; of equally long ones the first in the list.
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i].text.encode()), -i))

    @F.arrow_udf("int")
    def judge(urls: pa.Array) -> pa.Array:
        automaton = _compiled(patterns)
        states = automaton.states(urls.fill_null(""))
        found = np.full(len(urls), -1, np.int32)
        for i in range(len(rules), len(patterns)):
            found[automaton.matches(states, i)] = len(rules)
        for i in order:
            found[automaton.matches(states, i)] = i
        return pa.array(found)

    return judge


_kept: dict[tuple, Automaton] = {}


def _compiled(patterns: list[tuple[str, ...]]) -> Automaton:
    """The automaton of a worker, compiled once."""
    key = tuple(patterns)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Automaton(patterns)
    return _kept[key]


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows ``id_col, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; of those that fit, the
    longest decides, of equally long ones the first listed.  Where none fits, ``rule`` is null and the verdict
    is ``block`` if a glob matches the canonical URL, else ``allow``.  A null URL or one without ``://`` has
    an empty host and path, fits nothing and is allowed.  Rows of a null or repeated id are judged each for
    itself; an empty table gives an empty table; other columns are ignored; URLs of any length are followed
    to their end.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("_url"))
    code = verdicts(rules, globs)(F.col("_url"))
    names = F.array(*[F.lit(r.text) for r in rules]) if rules else F.array().cast("array<string>")
    actions = F.array(*[F.lit(r.action) for r in rules], F.lit("block"))
    return judged.select(id_col, "host", "path", code.alias("_code")).select(
        id_col,
        "host",
        "path",
        F.try_element_at(names, F.when((F.col("_code") >= 0) & (F.col("_code") < len(rules)), F.col("_code") + 1)).alias("rule"),
        F.when(F.col("_code") < 0, F.lit("allow")).otherwise(F.element_at(actions, F.greatest(F.col("_code"), F.lit(0)) + 1)).alias("verdict"),
    )


def allowed_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[str] = BLOCK_GLOBS, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` that are allowed, with all their columns; judged as :func:`judge_urls` does."""
    code = verdicts(rules, globs)(canonical(F.col(url_col)))
    allowing = [i for i, r in enumerate(rules) if r.action == "allow"]
    return pages.where(code.isin([-1, *allowing]))
