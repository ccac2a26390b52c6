"""Pairs of large pieces against every matching, filling against its rules, and documents cut no more than they must be."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skymill.llm import matching, packing, queries

WORDS = queries.word_model(queries.WORD_MODEL)


def most_pairs(lengths, capacity):
    """The most disjoint pairs that fit, by trying all."""
    if len(lengths) < 2:
        return 0
    first, rest = lengths[0], lengths[1:]
    return max([most_pairs(rest, capacity)] + [1 + most_pairs(rest[:k] + rest[k + 1 :], capacity) for k, x in enumerate(rest) if first + x <= capacity])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(5, 12), max_size=8))
def test_no_matching_has_more_pairs(lengths):
    lengths = sorted(lengths, reverse=True)
    pairs = matching.matched_pairs(lengths, 12)
    assert Counter(i for p in pairs for i in p if i is not None) == Counter(range(len(lengths)))
    assert all(b is None or lengths[a] + lengths[b] <= 12 for a, b in pairs)
    assert sum(b is not None for _, b in pairs) == most_pairs(lengths, 12)


def fewest_windows(lengths, capacity):
    """The fewest windows, by trying all ways."""
    best, rooms = len(lengths), []

    def place(i):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:k]:
                rooms[k] -= lengths[i]
                place(i + 1)
                rooms[k] += lengths[i]
        rooms.append(capacity - lengths[i])
        place(i + 1)
        rooms.pop()

    place(0)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_windows_are_whole_and_few(lengths):
    window, offset = matching.match_and_fill(np.array(lengths, np.int64), 12)
    held = defaultdict(list)
    for w, o, n in zip(window.tolist(), offset.tolist(), lengths, strict=True):
        held[w].append((o, n))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for o, n in parts if o < at) for at, _ in sorted(parts)]
        assert sum(n for _, n in parts) <= 12
    assert sorted(held) == list(range(len(held)))
    best = fewest_windows(lengths, 12)
    assert best <= len(held) <= best + 1
    if all(n > 4 for n in lengths):
        assert len(held) == best


def test_small_pieces_fill_the_tightest_gap():
    window, offset = matching.match_and_fill(np.array([70, 60, 35, 30, 10, 30]), 100)
    # 60 + 35 leave 5, 70 leaves 30: the first 30 goes there, the other one opens a window, which then holds 10.
    assert window[1] == window[2] and offset[2] == 60
    assert window[0] == window[3] and offset[3] == 70
    assert window[4] == window[5] and offset[4] == 30
    assert len(set(window.tolist())) == 3


def test_equal_pieces_by_the_thousand():
    for n, per in ((2000, 2), (1366, 2), (1365, 3), (4096, 1)):
        window, _ = matching.match_and_fill(np.full(30_000, n))
        assert max(Counter(window.tolist()).values()) == per and window.max() + 1 == 30_000 // per


@pytest.mark.parametrize("capacity", [8, 64, packing.WINDOW])
def test_only_long_documents_are_cut(docs, capacity):
    got = matching.pack_documents(docs, WORDS, end_id=1, capacity=capacity).collect()
    for r in got:
        assert r.start == r.piece * capacity and r.length == min(capacity, r.doc_tokens - r.start) and len(r.ids) == r.length * r.width
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= capacity and all(used[r.sequence_id] == r.sequence_tokens for r in got)
