"""HTML to events and to a tree, and a matcher for the selectors that source configs use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no part of the text around them.
HIDDEN = frozenset(("script", "style", "template"))


def squash(value) -> str | None:
    """White space collapsed and trimmed; blank is None."""
    return None if value is None else " ".join(str(value).split()) or None


class _Recorder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag.lower(), {k.lower(): v for k, v in attrs}))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("single", tag.lower(), {k.lower(): v for k, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("end", tag.lower(), None))

    def handle_data(self, data):
        self.events.append(("text", data, None))


def events(html: str, whole: bool = False) -> list[tuple]:
    """(kind, tag or text, attributes) in order; kinds are start, single, end and text.

    Text behind the last tag is only reported with ``whole``."""
    recorder = _Recorder()
    recorder.feed(html or "")
    if whole:
        recorder.close()
    return recorder.events


class Element:
    """A tag; ``nodes`` holds its texts and elements in order."""

    __slots__ = ("tag", "attrs", "parent", "nodes")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.parent, self.nodes = tag, attrs or {}, parent, []

    @property
    def children(self) -> list[Element]:
        return [n for n in self.nodes if isinstance(n, Element)]

    def below(self) -> Iterator[Element]:
        """Elements under this one in document order, without recursion."""
        stack = [iter(self.nodes)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif isinstance(node, Element):
                yield node
                stack.append(iter(node.nodes))

    def above(self) -> Iterator[Element]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def class_has(self, *parts: str) -> bool:
        """The class attribute contains one of the parts, in any case."""
        low = (self.attrs.get("class") or "").lower()
        return any(p in low for p in parts)

    def text(self) -> str:
        """All visible texts in document order, trimmed and joined by blanks."""
        found: list[str] = []
        stack: list[Iterator] = [iter(self.nodes)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif isinstance(node, Element):
                if node.tag not in HIDDEN:
                    stack.append(iter(node.nodes))
            elif node.strip():
                found.append(node.strip())
        return " ".join(found)

    def own_text(self) -> str | None:
        return squash(" ".join(t for t in (squash(n) for n in self.nodes if isinstance(n, str)) if t))

    def card_text(self) -> str | None:
        """Own texts first, then those of the elements inside, each in the same way."""
        order: list[str] = []
        stack = [self]
        while stack:
            at = stack.pop()
            own = at.own_text()
            if own:
                order.append(own)
            stack += reversed(at.children)
        return squash(" ".join(order))


def tree(html: str, whole: bool = False) -> Element:
    """The document's tree: an end tag closes all up to its start, one without a start is ignored."""
    root = at = Element("document")
    for kind, what, attrs in events(html, whole):
        if kind == "text":
            at.nodes.append(what)
        elif kind == "end":
            opened = next((e for e in (at, *at.above()) if e.tag == what and e.parent is not None), None)
            if opened is not None:
                at = opened.parent
        else:
            element = Element(what, attrs, at)
            at.nodes.append(element)
            if kind == "start" and what not in VOID:
                at = element
    return root


_TOKEN = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<class>(?:\\.|[\w-])+)|\#(?P<id>(?:\\.|[\w-])+)
      |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>(?:\\.|[^"])*)"|'(?P<sq>(?:\\.|[^'])*)'|(?P<bare>[^\]\s]+))\s*)?\]""",
    re.VERBOSE,
)


class Selector:
    """Tags, classes, ids and attribute tests, alone or joined, as descendants or children."""

    def __init__(self, css: str):
        self.alternatives = [self._chain(part.strip()) for part in re.split(r",(?![^\[]*\])", css)]

    @staticmethod
    def _chain(css: str) -> list[tuple[str, list[tuple]]]:
        chain, at, joint = [], 0, " "
        tests: list[tuple] = []
        while at < len(css):
            gap = re.compile(r"\s*>\s*|\s+").match(css, at)
            if gap:
                chain.append((joint, tests))
                joint, tests, at = (">" if ">" in gap[0] else " "), [], gap.end()
                continue
            token = _TOKEN.match(css, at)
            if not token:
                raise ValueError(f"unsupported selector: {css!r}")
            plain = lambda v: re.sub(r"\\(.)", r"\1", v)
            kind = token.lastgroup
            if token["tag"]:
                tests.append(("tag", token["tag"].lower(), None))
            elif token["class"]:
                tests.append(("class", plain(token["class"]), None))
            elif token["id"]:
                tests.append(("id", plain(token["id"]), None))
            else:
                value = next((plain(token[g]) for g in ("dq", "sq", "bare") if token[g] is not None), None)
                tests.append((token["op"] or "has", token["attr"].lower(), value))
            assert kind
            at = token.end()
        chain.append((joint, tests))
        return chain

    @staticmethod
    def _fits(e: Element, tests: list[tuple]) -> bool:
        for kind, name, value in tests:
            got = e.attrs.get(name) if kind not in ("tag", "class", "id") else None
            if kind == "tag":
                ok = name in ("*", e.tag)
            elif kind == "class":
                ok = name in e.classes
            elif kind == "id":
                ok = e.attrs.get("id") == name
            elif kind == "has":
                ok = name in e.attrs
            elif got is None:
                ok = False
            elif kind == "=":
                ok = got == value
            else:
                ok = bool(value) and {
                    "^=": got.startswith(value), "$=": got.endswith(value), "*=": value in got, "~=": value in got.split(),
                    "|=": got == value or got.startswith(value + "-"),
                }[kind]
            if not ok:
                return False
        return True

    def matches(self, e: Element) -> bool:
        return any(self._chain_fits(e, chain, len(chain) - 1) for chain in self.alternatives)

    def _chain_fits(self, e: Element, chain, i: int) -> bool:
        joint, tests = chain[i]
        if not self._fits(e, tests):
            return False
        if i == 0:
            return True
        if joint == ">":
            return e.parent is not None and self._chain_fits(e.parent, chain, i - 1)
        return any(self._chain_fits(p, chain, i - 1) for p in e.above())

    def all(self, scope: Element) -> list[Element]:
        return [e for e in scope.below() if self.matches(e)]

    def first(self, scope: Element) -> Element | None:
        return next((e for e in scope.below() if self.matches(e)), None)
