"""Best-fit decreasing packing of token documents into windows, with a segment tree over remaining capacity.

A document longer than a window is first cut into full windows and a rest; rests and short documents are then
placed, longest first, each into the open window with the least room that still holds it.

Pieces are dealt to shards by a hash, and shards are packed side by side; a shard gets about SHARD_WINDOWS
windows' worth of ids at any input size, so that its one incompletely filled tail costs next to nothing.
Null and empty texts are documents that hold only the end id; rows with equal ids are packed as separate documents. An
empty table gives no pieces. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stage_table, text_list
from .wordids import word_encoder

WINDOW = 4096
SHARD_WINDOWS = 4096
#: Window number and offset for each of the lengths, given the capacity.
Fit = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


class RoomTree:
    """Open windows by remaining capacity; finds the tightest that holds a length in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the least room >= length."""
        node = length + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each piece; lengths lie in 1..capacity. Ties go by position."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    window[order[:full]] = np.arange(full)
    tree, made = RoomTree(capacity), full
    for i in order[full:].tolist():
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


def cut_pieces(docs: DataFrame, model_json: str, end_id: int, capacity: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32) and, with_ids, (ids binary, width): each document's ids and end_id, cut into full windows and a rest.

    ids_crc32: over the piece's ids as u32.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = word_encoder(model_json)
        width, end, rows = encoder.width, end_id.to_bytes(encoder.width, "little"), []
        for key, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch(text_list(batch.column(1))), strict=True):
            ids += end
            n = len(ids) // width
            for at in range(0, n, capacity):
                part = ids[at * width : (at + capacity) * width]
                rows.append((key, at, len(part) // width, n, zlib.crc32(np.frombuffer(part, encoder.dtype).astype("<u4")), part))
        *columns, ids = zip(*rows, strict=True)
        out = {n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "length", "doc_tokens", "ids_crc32"), columns, strict=True)}
        if with_ids:
            out |= {"ids": pa.array(ids, pa.binary()), "width": pa.array([width] * len(rows), pa.int32())}
        return pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + ", ids binary, width int" * with_ids
    return map_rows(docs, [id_col, text_col], run, schema, keeps=True)


def pack(pieces: DataFrame, capacity: int = WINDOW, shard_windows: int = SHARD_WINDOWS, fit: Fit = best_fit) -> DataFrame:
    """The pieces with sequence_id, offset and sequence_tokens; any further columns (ids, checksums) go along.

    pieces: a staged table, as it is read twice (once for its total length). A shard's pieces meet in one task,
    which holds about shard_windows * capacity ids however long the input is.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, math.ceil(total / (capacity * shard_windows)))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        shard_of = table.column("__shard").to_numpy()
        for shard in np.unique(shard_of):
            own = table.filter(pa.array(shard_of == shard)).drop_columns(["__shard"])
            lengths = own.column("length").to_numpy()
            window, offset = fit(lengths, capacity)
            used = np.bincount(window, lengths).astype(np.int64)
            own = own.append_column("sequence_id", pa.array((int(shard) << 32) + window)).append_column("offset", pa.array(offset)).append_column("sequence_tokens", pa.array(used[window]))
            yield from own.to_batches()

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, sequence_tokens long"
    # By the row's place in the staged table: equal rows, however many, are dealt out as well.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = pieces.select(*names, shard.alias("__shard")).repartitionById(shards, F.col("__shard"))
    # Sorted, so that a repeated task packs its shard alike.
    return dealt.sortWithinPartitions("doc_id", "start", *[c for c in names if c not in ("doc_id", "start")]).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, model_json: str, end_id: int, capacity: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Every piece of every document (see cut_pieces) with sequence_id, offset and sequence_tokens."""
    pieces = stage_table(cut_pieces(docs, model_json, end_id, capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity)
