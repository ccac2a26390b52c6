"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into blocks, each with a covering code: a linear code whose words (the anchors) come
within a covering radius R of every bit pattern. Two fingerprints that differ in at most T bits differ in at most
t = T // blocks bits in some block; there, one's nearest anchor (distance <= R) lies within R + t of the other. So each
fingerprint is at home at one anchor for each block and visits all anchors within R + t, and homes are compared with
visitors anchor by anchor. Nothing within T bits is missed, whatever the data.

Equal fingerprints are collapsed first, so copies cost one row. What an anchor finds is reported as a spanning forest,
at most one row for each fingerprint there, never as all pairs. Anchors with many homes or visitors are split into chunks
of either, and every chunk of homes meets every chunk of visitors. Components come from repeated minimum-label steps over those links.

Null and empty texts have the fingerprint zero and are linked like any other. Equal doc_ids are one document. A null
doc_id never names a component; a component without any other id has a null one. An empty table gives an empty result.
Other columns, whatever their names, are not read, or stay as they are where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_name, join_by_key, map_rows, shuffle_partitions, stage_table, text_list
from .graph import component_ids, connected, spanning

WORDS = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints beyond this number use larger blocks (fewer, more selective anchors); either way is complete.
WIDE_FROM = 200_000_000
#: Homes at one anchor, and visitors, that are compared as one group.
CHUNK, VISITORS = 8192, 1 << 16
#: Rows held by a comparing task (more than a group has), pairs compared at once, and pairs beyond which a group is compared by itself.
HELD_ROWS = 1 << 18
PART_PAIRS = 1 << 20
GROUP_PAIRS = 1 << 16
#: Shingles hashed at once.
PART = 1 << 16

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    found = text.encode().translate(LOWER).split()
    if not found:
        return 0
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    k = min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), PART):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : at + PART], ends[at : at + PART], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed number; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in text_list(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_rows(docs, [id_col, text_col], run, "doc_id long, fp long")


class Covering:
    """A covering of one block of bits: a Hamming code of 2**r - 1 bits, the block's other bits kept as they are.

    Its words are the patterns with syndrome zero and its covering radius is 1.
    """

    def __init__(self, shift: int, bits: int, r: int, threshold: int):
        self.shift, self.bits, self.r = shift, bits, r
        self.mask = (1 << bits) - 1
        self.near: dict[int, np.ndarray] = {}
        found: dict[int, list[int]] = {s: [] for s in range(1 << r)}
        for weight in range(threshold + 2):
            for flips in combinations(range(bits), weight):
                s = 0
                for f in flips:
                    s ^= f + 1 if f < (1 << r) - 1 else 0
                found[s].append(sum(1 << f for f in flips))
        self.near = {s: np.array(x, np.int64) for s, x in found.items()}

    def syndromes(self, block: np.ndarray) -> np.ndarray:
        """Which single flip (numbered from 1) reaches the code; 0: none needed."""
        s = np.zeros(len(block), np.int64)
        for f in range((1 << self.r) - 1):
            s ^= (block >> f & 1) * (f + 1)
        return s

    def homes(self, fps: np.ndarray) -> np.ndarray:
        """Each fingerprint's own anchor."""
        block = (fps >> self.shift) & self.mask
        s = self.syndromes(block)
        return np.where(s > 0, block ^ (1 << np.maximum(s - 1, 0)), block)

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the fingerprint and anchor, for all anchors within the covering radius plus the threshold."""
        block = (fps >> self.shift) & self.mask
        s = self.syndromes(block)
        rows, anchors = [], []
        for value in np.unique(s):
            own, flips = np.flatnonzero(s == value), self.near[int(value)]
            rows.append(np.repeat(own, len(flips)))
            anchors.append((block[own][:, None] ^ flips[None, :]).ravel())
        return np.concatenate(rows), np.concatenate(anchors)


def coverings(n_blocks: int, max_bits: int = MAX_BITS) -> list[Covering]:
    """Blocks of 64 / n_blocks bits; 3 blocks of 21 to 22 bits have anchors of 17 to 18 free bits, 2 blocks of 32 have 27."""
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    return [Covering(a, b - a, 5 if b - a >= 31 else 4, max_bits // n_blocks) for a, b in zip(cuts, cuts[1:], strict=False)]


def forest(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (home, visitor) within max_bits that join what any such pair joins; at most one for each fingerprint.

    Rows of the comparison are done in parts, so memory stays within a few MB.
    """
    everyone = np.unique(np.concatenate([homes, visitors]))
    h, v = np.searchsorted(everyone, homes), np.searchsorted(everyone, visitors)
    root = np.arange(len(everyone))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step, left, right = max(1, (1 << 20) // max(1, len(v))), [], []
    for at in range(0, len(h), step):
        part = h[at : at + step]
        close = np.bitwise_count((everyone[part][:, None] ^ everyone[v][None, :]).view(np.uint64)) <= max_bits
        close &= part[:, None] != v[None, :]
        for row in np.flatnonzero(close.any(1)).tolist():
            a = find(int(part[row]))
            others = v[close[row]]
            for b in others[root[others] != a].tolist():
                if (c := find(b)) != a:
                    root[c] = a
                    left.append(int(part[row]))
                    right.append(b)
    return everyone[np.array(left, np.int64)], everyone[np.array(right, np.int64)]


def links_of(key: np.ndarray, home: np.ndarray, fps: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of whole groups of rows with equal keys, in each the homes first.

    Small groups are compared all at once, large ones one by one.
    """
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
    starts, sizes = starts[:-1], np.diff(starts)
    if not len(starts):
        return
    homes = np.add.reduceat(home.astype(np.int64), starts)
    pairs = homes * sizes
    for g in np.flatnonzero((pairs > GROUP_PAIRS) & (sizes > 1)).tolist():
        own = fps[starts[g] : starts[g] + sizes[g]]
        a, b = forest(np.unique(own[: homes[g]]), np.unique(own), max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    small = np.flatnonzero((pairs > 0) & (pairs <= GROUP_PAIRS) & (sizes > 1))
    ends = np.cumsum(pairs[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_PAIRS, "right")))
        g = small[at:to]
        n = np.repeat(sizes[g], pairs[g])
        i = np.arange(len(n)) - np.repeat(np.cumsum(pairs[g]) - pairs[g], pairs[g])
        first = np.repeat(starts[g], pairs[g])
        a, b = fps[first + i // n], fps[first + i % n]
        close = (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits) & (a != b)
        a, b = spanning(a[close], b[close])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        at = to


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that span all pairs within max_bits. distinct: a staged (fp, ...)."""
    plan = coverings(3 if distinct.count() < WIDE_FROM else 2, max_bits)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                for k, cover in enumerate(plan):
                    rows, anchors = cover.visits(fps)
                    home = anchors == cover.homes(fps)[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(anchors * 4 + k), pa.array(home), pa.array(fps[rows])], ["anchor", "home", "fp"])

    spread = distinct.select("fp").mapInArrow(replicate, "anchor long, home boolean, fp long")
    # Anchors with homes and more than one fingerprint; few enough homes make one chunk.
    counts = spread.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("n"))
    hot = counts.filter((F.col("homes") > 0) & ((F.col("homes") > CHUNK) | (F.col("n") > VISITORS)))
    hot = stage_table(hot.select("anchor", F.ceil(F.col("homes") / CHUNK).cast("int").alias("rows"), F.ceil(F.col("n") / VISITORS).cast("int").alias("columns")), "hot")
    if hot.take(1):
        # Fewer than all replicated rows / CHUNK anchors are hot.
        spread = spread.join(F.broadcast(hot) if hot.count() < 100_000 else hot, "anchor", "left")
        cold = spread.filter(F.col("rows").isNull()).select("anchor", F.lit(0).alias("row"), F.lit(0).alias("column"), "home", "fp")
        split = spread.filter(F.col("rows").isNotNull())
        own = F.xxhash64("fp")
        as_home = split.filter("home").select("anchor", F.pmod(own, F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), "home", "fp")
        as_visitor = split.select("anchor", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(F.xxhash64(own), F.col("columns")).cast("int").alias("column"), F.lit(False).alias("home"), "fp")
        spread = cold.unionByName(as_home).unionByName(as_visitor)
    else:
        spread = spread.select("anchor", F.lit(0).alias("row"), F.lit(0).alias("column"), "home", "fp")
    groups = ["anchor", "row", "column"]
    dealt = spread.repartition(shuffle_partitions(distinct.sparkSession), *groups).sortWithinPartitions(*groups, F.col("home").desc())

    def group_numbers(keys: list[np.ndarray]) -> np.ndarray:
        change = np.zeros(len(keys[0]), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        return np.cumsum(change)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                key = group_numbers(every[:3])
                done = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
                yield from links_of(key[:done], every[3][:done], every[4][:done], max_bits)
                held, rows = [tuple(x[done:] for x in every)], len(key) - done
        if rows:
            every = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield from links_of(group_numbers(every[:3]), every[3], every[4], max_bits)

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable by links, the document's own included."""
    prints = stage_table(fingerprints(docs, id_col, text_col), "prints", narrow=True)
    distinct = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    named = component_ids(distinct, near_links(distinct, max_bits), "fp")
    return join_by_key(prints, stage_table(named, "named"), "fp", "n", "inner").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one of each component left: the one with the least doc_id, with all its columns.

    Rows that share that doc_id count as one document: the first by text stays. Where a component has no doc_id
    at all, the first of its rows by text stays.
    """
    mark = clear_name(docs.columns, "near")
    kept_id, own_id = f"{mark}_id", F.col(f"`{id_col}`")
    found = stage_table(near_duplicates(docs, id_col, text_col, max_bits).filter("doc_id is not null and component_id is not null"), "found")
    named = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("lead"))
    leaders = stage_table(named, "named")
    once = leaders.filter("lead and n = 1").select(F.col("doc_id").alias(kept_id))
    # Ids are hashed and texts stream past them: texts are shuffled once and never sorted, at any size.
    kept = docs.join(once.hint("shuffle_hash"), own_id == F.col(kept_id), "left_semi")
    # Repeated ids and null ids are rare; only their rows are sorted.
    odd = leaders.filter("lead and n > 1").select(F.col("doc_id").alias(kept_id))
    if odd.take(1):
        kept = kept.unionByName(_first_of(docs.join(odd, own_id == F.col(kept_id), "left_semi"), id_col, text_col, mark))
    nameless = docs.filter(own_id.isNull())
    if nameless.take(1):
        kept = kept.unionByName(_nameless(docs, nameless, text_col, id_col, max_bits, mark))
    return kept


def _first_of(rows: DataFrame, key: str, text_col: str, mark: str) -> DataFrame:
    """One row for each value of key: the first by text."""
    order = Window.partitionBy(f"`{key}`").orderBy(F.col(f"`{text_col}`").asc_nulls_first())
    return rows.withColumn(f"{mark}_rank", F.row_number().over(order)).filter(F.col(f"{mark}_rank") == 1).drop(f"{mark}_rank")


def _nameless(docs: DataFrame, nameless: DataFrame, text_col: str, id_col: str, max_bits: int, mark: str) -> DataFrame:
    """Of rows without doc_id, those whose component has no doc_id: one for each distinct text's component."""
    text = F.col(f"`{text_col}`")
    found = near_duplicates(docs, id_col, text_col, max_bits).filter("component_id is null").select("fp").distinct()
    texts = fingerprints(nameless.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))).distinct()
    links = stage_table(texts.join(found, "fp", "left_semi"), "nameless")
    roots = connected(near_links(stage_table(links.select("fp").distinct(), "fps"), max_bits))
    lead = links.join(roots, links["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("r")).agg(F.min("doc_id").alias(f"{mark}_hash"))
    rows = nameless.withColumn(f"{mark}_hash", F.xxhash64(text)).join(lead.select(f"{mark}_hash"), f"{mark}_hash", "left_semi")
    return _first_of(rows, f"{mark}_hash", text_col, mark).drop(f"{mark}_hash").select(*[F.col(f"`{c}`") for c in docs.columns])
