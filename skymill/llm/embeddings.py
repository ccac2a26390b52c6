"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard of the vectors.

Equal vectors are collapsed. Every shard's task builds a graph in numpy, by batches: a batch searches the graph as it
stands, its members are joined to diverse near nodes, and those nodes' links are pruned alike. Then each pair of shards
is searched from both sides, and a link that either side finds counts for both its ends. A beam that ends full of linked
vectors is widened for that query. Before a graph is relied on, a block of queries and vectors that are planted near its
nodes, so that there are links to find however rare real ones are, are compared with its whole shard, and the beam is
widened until it finds their links. Nodes that a search from their own place does not reach are compared with every query.
What is found is verified by cosine in double precision, links are counted, and a spanning forest of them is united to
components.

Vectors that are null, zero, or hold null or non-finite components link with nothing, not even with their equals; nor do
vectors of different lengths. A null vec_id never names a component. Equal rows are copies of one vector and link. An
empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import io
import logging
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, shared_root, stage_table
from .graph import component_ids, spanning

log = logging.getLogger(__name__)

MIN_COSINE = 0.9
#: Vectors in a shard at most on average, and shards at least (they are built side by side).
SHARD_ROWS = 50_000
MIN_SHARDS = 6
#: Bytes of a shard's vectors at most on average; a task holds two shards, and each component in double and single precision.
SHARD_BYTES, COMPONENT_BYTES = 128 << 20, 12
#: Tasks of a search at most; beyond that a task compares several pairs of shards.
PAIR_TASKS = 1 << 16
#: Queries that search together; a multiple of 8.
BLOCK = 256
#: Links of a node above the lowest layer (twice as many there), and beams while building and at first for queries.
DEGREE, BUILD_BEAM, BEAM = 12, 40, 24
#: Planted queries of an audit, and the recall that it must reach: of the links, and on average over the queries.
AUDITS, MIN_RECALL = 256, 0.98
#: Shards of up to so many vectors are compared whole: a search would visit as many.
WHOLE_ROWS = 1024


class SmallWorld:
    """A layered graph over unit vectors; layers[k][node] lists the node's links in layer k, -1 where there are fewer."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: int):
        self.unit, self.layers, self.entry = unit, layers, entry
        self._lost: np.ndarray | None = None
        #: Links that audits of searches in this graph knew, and how many of them the beam found that was then used.
        self.audited = np.zeros(2, np.int64)

    @staticmethod
    def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> SmallWorld:
        """Nodes are inserted in the given order, which should be random; their top layers are drawn geometrically."""
        n = len(unit)
        top = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int)
        top[0] = top.max(initial=0)
        caps = [2 * degree] + [degree] * int(top[0])
        graph = SmallWorld(unit, [np.full((n, c), -1, np.int32) for c in caps], 0)
        at, size = 1, 32
        while at < n:
            graph._insert(np.arange(at, min(n, at + size)), top, beam)
            at, size = at + size, min(2 * size, 1024)
        return graph

    def _insert(self, new: np.ndarray, top: np.ndarray, beam: int) -> None:
        q = self.unit[new]
        near = np.full((len(new), 1), self.entry, np.int32)
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        found = []
        for k in range(len(self.layers) - 1, -1, -1):
            parts = [self._search(q[i : i + BLOCK], near[i : i + BLOCK], k, beam if k == 0 or (top[new] >= k).any() else 2) for i in range(0, len(new), BLOCK)]
            near, sims = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            mine = np.flatnonzero(top[new] >= k)
            if len(mine) > 1:
                peers = among[np.ix_(mine, mine)]
                m = min(len(mine) - 1, DEGREE)
                best = np.argpartition(-peers, m - 1, axis=1)[:, :m]
                ids = np.concatenate([near[mine], new[mine][best].astype(np.int32)], 1)
                values = np.concatenate([sims[mine], np.take_along_axis(peers, best, 1)], 1)
            else:
                ids, values = near[mine], sims[mine]
            found.append((k, new[mine], ids, values))
        for k, nodes, ids, values in found:
            if len(nodes):
                self._join(k, nodes, ids, values)

    def _join(self, k: int, nodes: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        adj = self.layers[k]
        cap = adj.shape[1]
        for i in range(0, len(nodes), BLOCK):
            part = slice(i, i + BLOCK)
            adj[nodes[part], : cap // 2] = self._diverse(ids[part], values[part], cap // 2)
        # Links back: each target weighs what it has against what is new.
        source = np.repeat(nodes, cap // 2)
        target = adj[nodes, : cap // 2].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        for i in range(0, len(hit), BLOCK):
            own, width = hit[i : i + BLOCK], int(min(count[i : i + BLOCK].max(), 3 * cap))
            place = first[i : i + BLOCK, None] + np.arange(width)[None, :]
            fresh = np.where(np.arange(width)[None, :] < count[i : i + BLOCK, None], source[np.minimum(place, len(source) - 1)], -1)
            every = np.concatenate([adj[own], fresh.astype(np.int32)], 1)
            sims = np.einsum("rkd,rd->rk", self.unit[every], self.unit[own])
            sims[(every < 0) | (every == own[:, None])] = -np.inf
            adj[own] = self._diverse(every, sims, cap)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to so many of each row's ids: first those nearer to the row's node than to any chosen before, then the nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = np.isfinite(sims)
        valid[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        v = self.unit[ids]
        mutual = v @ v.transpose(0, 2, 1)
        chosen, blocked = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32)
        for j in range(ids.shape[1]):
            ok = valid[:, j] & (sims[:, j] > blocked[:, j]) & (chosen.sum(1) < most)
            chosen[ok, j] = True
            blocked[ok] = np.maximum(blocked[ok], mutual[ok, j])
        rank = np.where(chosen, 0, np.where(valid, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((len(ids), most), -1, np.int32)
        out[:, : order.shape[1]] = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
        return out

    def _search(self, q: np.ndarray, start: np.ndarray, k: int, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of layer k that a beam finds from the start nodes, with their cosines; all queries step together."""
        adj, rows = self.layers[k], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.unit)), bool)
        beam = max(beam, start.shape[1])
        sims = np.einsum("rkd,rd->rk", self.unit[start], q)
        sims[start < 0] = -np.inf
        seen[rows, start] = True
        pad = beam - start.shape[1]
        ids = np.concatenate([start, np.full((len(q), pad), -1, np.int32)], 1)
        sims = np.concatenate([sims, np.full((len(q), pad), -np.inf, np.float32)], 1).astype(np.float32)
        live = np.isfinite(sims)
        while True:
            rank = np.where(live, sims, -np.inf)
            act = np.flatnonzero(live.any(1))
            if not len(act):
                break
            w = min(width, beam)
            pick = np.argpartition(-rank[act], w - 1, axis=1)[:, :w]
            ok = np.take_along_axis(live[act], pick, 1)
            cur = np.take_along_axis(ids[act], pick, 1)
            part = live[act]
            np.put_along_axis(part, pick, False, 1)
            live[act] = part
            near = np.where(ok[:, :, None], adj[cur], -1).reshape(len(act), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[act[:, None], near]
            some = fresh.any(1)
            if not some.any():
                continue
            act, near, fresh = act[some], near[some], fresh[some]
            r, c = np.nonzero(fresh)
            seen[act[r], near[r, c]] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("ij,ij->i", self.unit[near[r, c]], q[act[r]])
            all_ids, all_sims, all_live = np.concatenate([ids[act], near], 1), np.concatenate([sims[act], value], 1), np.concatenate([live[act], fresh], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[act], sims[act], live[act] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_live))
            live[act] &= np.isfinite(sims[act])
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.full((len(q), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            near = self._search(q, near, k, 4, 2)[0]
        return self._search(q, near, 0, beam)

    def whole(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of cosine >= least by comparison with every node."""
        return np.nonzero(q @ self.unit.T >= least)

    def near(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of cosine >= least that the beam finds; where it ends full of them, a wider one."""
        todo, rows, nodes = np.arange(len(q)), [], []
        while len(todo):
            if 2 * beam >= len(self.unit):
                r, c = self.whole(q[todo], least)
                rows.append(todo[r])
                nodes.append(c)
                break
            step = max(1, BLOCK * BEAM // beam)
            parts = [self.query(q[todo[i : i + step]], beam) for i in range(0, len(todo), step)]
            ids, sims = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            full = sims[:, -1] >= least
            r, c = np.nonzero((sims >= least) & ~full[:, None])
            rows.append(todo[r])
            nodes.append(ids[r, c])
            todo, beam = todo[full], 4 * beam
        return np.concatenate(rows), np.concatenate(nodes)

    def audited_beam(self, q: np.ndarray, own: np.ndarray, truth: np.ndarray, least: float) -> int:
        """The least beam, by doubling, that finds enough of the queries' links. own: the query's own node or -1; truth: its links to others."""
        beam = BEAM
        while 2 * beam < len(self.unit):
            found = np.zeros(len(q), np.int64)
            for i in range(0, len(q), BLOCK):
                r, c = self.near(q[i : i + BLOCK], least, beam)
                found += np.bincount(r[c != own[i + r]] + i, minlength=len(q))
            found = np.minimum(found, truth)
            last = np.array([truth.sum(), found.sum()])
            if found.sum() >= MIN_RECALL * truth.sum() and (found / truth).mean() >= MIN_RECALL:
                break
            beam *= 2
        else:
            last = np.array([truth.sum()] * 2)
        self.audited += last
        return beam

    def lost(self) -> np.ndarray:
        """Nodes that a search from their own place does not reach; they are compared with every query. Found once."""
        if self._lost is None:
            missed = []
            for at in range(0, len(self.unit), BLOCK):
                own = np.arange(at, min(at + BLOCK, len(self.unit)))
                missed.append(own[~(self.query(self.unit[own], BEAM)[0] == own[:, None]).any(1)])
            self._lost = np.concatenate([np.zeros(0, np.int64), *missed])
        return self._lost

    def planted(self, least: float, n: int = AUDITS) -> np.ndarray:
        """Unit vectors that are linked to a node: at a cosine between least and half the way from it to 1."""
        rng = np.random.default_rng(11)
        u = self.unit[rng.choice(len(self.unit), min(n, len(self.unit)), replace=False)]
        v = rng.standard_normal(u.shape).astype(np.float32)
        v -= (v * u).sum(1, keepdims=True) * u
        c = rng.uniform(least + 1e-3, (1 + least) / 2, (len(u), 1)).astype(np.float32)
        return c * u + np.sqrt(1 - c * c) * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)

    def within(self, q: np.ndarray, least: float, same: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """For every block of queries its first query, (query in the block, node) of cosine >= least, and whether none can be missing.

        same: the queries are the nodes; then a query's own node is no link and proves nothing. The beam is audited on
        planted queries and on a block of real ones, all compared with every node.
        """
        starts = (np.random.default_rng(7).permutation(-(-len(q) // BLOCK)) * BLOCK).tolist()
        if len(self.unit) <= WHOLE_ROWS:
            for at in starts:
                yield at, *self.whole(q[at : at + BLOCK], least), True
            return
        at = starts.pop()
        r, c = self.whole(q[at : at + BLOCK], least)
        yield at, r, c, True
        if not starts:
            return
        real = np.bincount(r[c != r + at] if same else r, minlength=min(BLOCK, len(q) - at))
        made = self.planted(least)
        audits = np.concatenate([q[at : at + BLOCK][real > 0], made])
        own = np.concatenate([at + np.flatnonzero(real) if same else np.full((real > 0).sum(), -1), np.full(len(made), -1)])
        truth = np.concatenate([real[real > 0], np.bincount(self.whole(made, least)[0], minlength=len(made))])
        known = truth > 0
        beam = self.audited_beam(audits[known], own[known], truth[known], least)
        exact, lost = 2 * beam >= len(self.unit), self.lost()
        for at in starts:
            part = q[at : at + BLOCK]
            r, c = self.near(part, least, beam)
            if len(lost) and not exact:
                i, j = np.nonzero(part @ self.unit[lost].T >= least)
                r, c = np.concatenate([r, i]), np.concatenate([c, lost[j]])
            yield at, r, c, exact


def found_links(a: SmallWorld, b: SmallWorld, least: float) -> np.ndarray:
    """Bits (node of a, node of b) of the links that a search from either side finds; all if a and b are one graph."""
    bits = np.zeros((len(a.unit), -(-len(b.unit) // 8)), np.uint8)
    missing = False
    for at, r, c, exact in b.within(a.unit, least, a is b):
        hit = np.zeros((min(BLOCK, len(a.unit) - at), len(b.unit)), bool)
        hit[r, c] = True
        bits[at : at + len(hit)] |= np.packbits(hit, axis=1)
        if a is b and not exact:
            part = np.packbits(hit.T, axis=1)
            bits[:, at // 8 : at // 8 + part.shape[1]] |= part
        missing |= not exact
    if missing and a is not b:
        for at, r, c, _ in a.within(b.unit, least):
            hit = np.zeros((len(a.unit), min(BLOCK, len(b.unit) - at)), bool)
            hit[c, r] = True
            part = np.packbits(hit, axis=1)
            bits[:, at // 8 : at // 8 + part.shape[1]] |= part
    return bits


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in single precision; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def build_shards(vectors: DataFrame, shards: int) -> list[tuple[int, str]]:
    """Write each shard's graphs (one for each length of vectors) to the shared folder; returns lengths and files."""
    folder = f"{shared_root(vectors.sparkSession)}/graphs"
    store, base = _store(folder)
    store.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        dims = table["dims"].to_numpy()
        for d in np.unique(dims).tolist():
            own = table.filter(pa.array(dims == d)).combine_chunks()
            x = _matrix(own["embedding"].chunk(0))
            graph = SmallWorld.build(_unit(x))
            out = io.BytesIO()
            with np.errstate(over="ignore"):
                narrow = x.astype(np.float32)
            # Components that were single precision are kept so.
            np.savez(out, lost=graph.lost(), node=own["node"].to_numpy(), n=own["n"].to_numpy(), x=narrow if (narrow == x).all() else x, **{f"layer{i}": a for i, a in enumerate(graph.layers)})
            file = f"{uuid.uuid4().hex}.npz"
            store, base = _store(folder)
            with store.open_output_stream(f"{base}/{file}") as stream:
                stream.write(out.getbuffer())
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "file": [f"{folder}/{file}"]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    built = dealt.sortWithinPartitions(F.xxhash64("node")).select("node", "n", "dims", "embedding").mapInArrow(run, "dims int, file string")
    # A few names for each shard.
    return sorted((r["dims"], r["file"]) for r in stage_table(built, "graphs").collect())


def _load(uri: str) -> tuple[SmallWorld, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's graph, and its nodes, their copies and their vectors."""
    store, path = _store(uri)
    with store.open_input_stream(path) as stream:
        held = np.load(io.BytesIO(stream.read()))
    x = held["x"].astype(np.float64)
    graph = SmallWorld(_unit(x), [held[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in held.files))], 0)
    graph._lost = held["lost"]
    return graph, held["node"], held["n"], x


def shard_count(vectors: int, components: int) -> int:
    """Shards for that many vectors, which have that many components together: bounded in rows and in bytes."""
    return max(MIN_SHARDS, math.ceil(vectors / SHARD_ROWS), math.ceil(components * COMPONENT_BYTES / SHARD_BYTES))


def pair_at(number: int, n: int) -> tuple[int, int]:
    """Pair i <= j of n things by its number, in the order (0, 0), (0, 1), ..., (1, 1), ..., (n - 1, n - 1)."""
    behind = n * (n + 1) // 2 - 1 - number
    rows = (math.isqrt(8 * behind + 1) - 1) // 2
    return n - 1 - rows, n - 1 - (behind - rows * (rows + 1) // 2)


def search_shards(spark: SparkSession, files: list[tuple[int, str]], min_cosine: float) -> DataFrame:
    """(a, b, n, known, found): rows (node, null, copies of other vectors linked), some for each linked node, links (a, b, null) that span all found, and for each pair of shards what its audits knew and found.

    A task compares pairs of shards, or shards with themselves, one after another. It gets numbers of pairs and the shards'
    files; which pair a number means is computed there, so that pairs, which grow with the square of the shards, are no list.
    """
    alike: dict[int, list[str]] = {}
    for dims, file in files:
        alike.setdefault(dims, []).append(file)
    total = sum(len(of) * (len(of) + 1) // 2 for of in alike.values())

    def pair(number: int) -> tuple[str, str]:
        for of in alike.values():
            own = len(of) * (len(of) + 1) // 2
            if number < own:
                i, j = pair_at(number, len(of))
                return of[i], of[j]
            number -= own
        raise IndexError("no such pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (k for batch in batches for k in batch.column(0).to_pylist()):
            names_of = pair(number)
            same = names_of[0] == names_of[1]
            one = _load(names_of[0])
            graph, node, copies, x = one
            other, names, copies_b, y = one if same else _load(names_of[1])
            bits = found_links(graph, other, min_cosine - 1e-4)
            linked = np.zeros(len(x), np.int64)
            linked_b = linked if same else np.zeros(len(y), np.int64)
            left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(x), BLOCK):
                rows, cols = np.nonzero(np.unpackbits(bits[at : at + BLOCK], axis=1, count=len(y)))
                rows += at
                if same:
                    rows, cols = rows[rows < cols], cols[rows < cols]
                for i in range(0, len(rows), 1 << 16):
                    r, c = rows[i : i + (1 << 16)], cols[i : i + (1 << 16)]
                    a, b = x[r], y[c]
                    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
                    cosine = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
                    ok = cosine >= min_cosine
                    r, c = r[ok], c[ok]
                    np.add.at(linked, r, copies_b[c])
                    np.add.at(linked_b, c, copies[r])
                    left, right = spanning(np.concatenate([left, node[r]]), np.concatenate([right, names[c]]))
            for ids, n in [(node, linked)] if same else [(node, linked), (names, linked_b)]:
                some = n > 0
                yield rows_of(pa.array(ids[some]), None, pa.array(n[some]))
            yield rows_of(pa.array(left), pa.array(right), None)
            known, found = graph.audited if same else graph.audited + other.audited
            if known:
                yield rows_of(None, None, None, pa.array([known], pa.int64()), pa.array([found], pa.int64()))

    def rows_of(*columns: pa.Array | None) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        columns = [*columns, *[None] * (5 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else c for c in columns], ["a", "b", "n", "known", "found"])

    return spark.range(0, total, 1, min(max(1, total), PAIR_TASKS)).mapInArrow(run, "a long, b long, n long, known long, found long")


def audited_recall(found: DataFrame) -> float | None:
    """The share of the links known to the audits of search_shards that their beams found; None if no graph was relied on."""
    known, hit = found.agg(F.sum("known"), F.sum("found")).first()
    return hit / known if known else None


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of every row, in double precision; the embedding is null where it links with nothing."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Adding zero turns negative zeros into zeros, so that such vectors count as equal.
    return table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))).alias("embedding"))


def found_between(rows: DataFrame, min_cosine: float = MIN_COSINE) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors and what search_shards finds between them, both staged. rows: staged usable_vectors."""
    groups = rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = stage_table(groups.select(F.monotonically_increasing_id().alias("node"), "first_id", "n", F.size("embedding").alias("dims"), "embedding"), "classes")
    size = classes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("dims"), F.lit(0)).alias("components")).first()
    files = build_shards(classes, shard_count(size["rows"], size["components"]))
    return classes, stage_table(search_shards(rows.sparkSession, files, min_cosine), "found")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = stage_table(usable_vectors(table, id_col, vector_col), "vectors")
    classes, found = found_between(rows, min_cosine)
    if (recall := audited_recall(found)) is not None:
        log.info("audits found %.4f of the links they knew", recall)
    named = component_ids(classes.select("node", "first_id", "n"), found.filter("b is not null").select("a", "b"), "node")
    linked = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    of_vector = classes.select("node", "embedding").join(named, "node").join(linked, "node", "left").select("embedding", "component_id", "n", F.coalesce("linked", F.lit(0)).alias("linked"))
    joined = join_by_key(rows.filter("embedding is not null"), stage_table(of_vector, "named"), "embedding", "n", "inner")
    linked_rows = joined.select("vec_id", (F.col("linked") + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
