"""Packing into few windows: large pieces are matched in pairs, smaller ones fill the gaps.

A window holds at most two pieces of more than a third of its capacity, so these are a matching problem: longest first,
each takes the longest unmatched piece that still fits beside it. No other choice pairs more of them: whatever fits
beside the longest fits beside every later one as well. The smaller pieces then go, longest first, into the window with
the least room that holds them; a window is opened only where none does.

A document longer than a window is cut into full windows and a rest; no other is cut. Pieces are dealt to shards, which are
packed side by side (see packing.pack). Null and empty texts are documents that hold only the end id; rows with equal ids
are packed as separate documents. An empty table gives no pieces. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .packing import WINDOW, RoomTree, cut_pieces, pack


def matched_pairs(lengths: list[int], capacity: int) -> list[tuple[int, int | None]]:
    """(place, partner's place or None) of the lengths, which descend: each with the longest later one that fits beside it."""
    n, pairs = len(lengths), []
    # The next unmatched place from each on, found through short cuts.
    ahead = list(range(n + 1))

    def unmatched(i: int) -> int:
        while ahead[i] != i:
            ahead[i] = ahead[ahead[i]]
            i = ahead[i]
        return i

    # The first place whose length fits beside each.
    down = -np.asarray(lengths, np.int64)
    fits = np.searchsorted(down, -(capacity + down), "left")
    i = unmatched(0)
    while i < n:
        ahead[i] = i + 1
        partner = unmatched(max(i + 1, int(fits[i])))
        if partner < n:
            ahead[partner] = partner + 1
        pairs.append((i, partner if partner < n else None))
        i = unmatched(i)
    return pairs


def match_and_fill(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each piece; lengths lie in 1..capacity. Ties go by position."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    large = order[: int((3 * lengths > capacity).sum())]
    tree, made = RoomTree(capacity), 0
    for i, partner in matched_pairs(lengths[large].tolist(), capacity):
        a, used = large[i], int(lengths[large[i]])
        window[a] = made
        if partner is not None:
            b = large[partner]
            window[b], offset[b] = made, used
            used += int(lengths[b])
        if used < capacity:
            tree.add(capacity - used, made)
        made += 1
    for i in order[len(large) :].tolist():
        n = int(lengths[i])
        got = tree.take(n)
        if got is None:
            got = (capacity, made)
            made += 1
        room, window[i] = got
        offset[i] = capacity - room
        if room > n:
            tree.add(room - n, got[1])
    return window, offset


def pack_documents(docs: DataFrame, model_json: str, end_id: int, capacity: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Every piece of every document (see packing.cut_pieces) with its number in the document, sequence_id, offset and sequence_tokens."""
    pieces = stage_table(cut_pieces(docs, model_json, end_id, capacity, with_ids=with_ids), "pieces")
    packed = pack(pieces, capacity, fit=match_and_fill)
    return packed.withColumn("piece", (F.col("start") / capacity).cast("int"))
