from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haggle.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=6))
def test_deviation_stays_under_one_block(weights):
    slots = mixing.period(dict(enumerate(weights)))
    total = sum(weights)
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for s, w in enumerate(weights):
        for t in range(total + 1):
            had = sum(1 for x in slots[s] if x < t)
            assert abs(had - Fraction(w * t, total)) < 1


def by_hand(blocks, weights):
    """Slot after slot, with the sources that still have blocks."""
    left, done, stream = dict(blocks), {}, []
    while left:
        total, start = sum(weights[s] for s in left), len(stream)
        count = dict.fromkeys(left, 0)
        while all(left.values()):
            now = len(stream) - start
            ready = [(-(-(count[s] + 1) * total // weights[s]), s) for s in left if count[s] * total // weights[s] <= now]
            s = min(ready)[1]
            stream.append((s, done.get(s, 0)))
            done[s] = done.get(s, 0) + 1
            count[s] += 1
            left[s] -= 1
        left = {s: n for s, n in left.items() if n}
    return stream


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 7)), min_size=1, max_size=5))
def test_schedule_matches_slot_by_slot_simulation(sources):
    blocks = {s: n for s, (n, _) in enumerate(sources)}
    weights = {s: w for s, (_, w) in enumerate(sources)}
    placed = {}
    for p in mixing.schedule(blocks, weights):
        for s in p.first:
            for b in range(p.first[s], p.last[s]):
                i = b - p.first[s]
                slot = p.start + i // weights[s] * p.total + p.slots[s][i % weights[s]]
                assert slot not in placed
                placed[slot] = (s, b)
    assert [placed[i] for i in range(len(placed))] == by_hand(blocks, weights)


def test_every_document_has_one_position(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED_AT_ONCE", 50)
    rows = [(i, f"t{i % 7}", ["a", "b", None][min(2, i % 5)], i) for i in range(300)] + [(1, "t1", "b", 0), (None, None, "a", 0), (1, "t1", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    got = mixing.mix(docs, {"a": 3, "b": 2}, block=4).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    per = {}
    for r in got:
        per.setdefault((r.source, r.block), set()).add((r.slot, r.place))
    for places in per.values():
        assert len({s for s, _ in places}) == 1
        assert sorted(p for _, p in places) == list(range(len(places)))
    # The whole schedule, slot after slot, from the blocks that the sources have.
    number = {src: 1 + max(b for s, b in per if s == src) for src in ("a", "b", None)}
    names, weights = {"a": "+a", "b": "+b", None: "-"}, {"+a": 3, "+b": 2, "-": 1}
    stream = by_hand({names[s]: n for s, n in number.items()}, weights)
    assert {(names[r.source], r.block): r.slot for r in got} == {(s, b): i for i, (s, b) in enumerate(stream)}
    # Positions follow slots and places, and inside a source blocks follow the hash of id and text.
    assert [r.position for r in sorted(got, key=lambda r: (r.slot, r.place))] == list(range(len(rows)))
    kept = mixing.mix(docs, {"a": 3, "b": 2}, block=4, keep=True).collect()
    want = [(r.doc_id, r.source) for r in sorted(got, key=lambda r: r.position)]
    assert [(r.doc_id, r.source) for r in kept] == want
    assert kept[0].__fields__ == ["doc_id", "text", "source", "block"]
    assert mixing.mix(docs.limit(0), {"a": 1}).count() == 0
    assert mixing.mix(docs.limit(0), {"a": 1}, keep=True).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})
