"""Near duplicates of texts and vectors against comparison of all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skymill.llm import embeddings, graph, simhash


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  ", "one", "A b C", "a b c d", "a b c d e f g a b c d", "É é ÀB b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize(("blocks", "bits"), [(3, 4), (2, 4), (4, 3)])
def test_coverings_meet_every_pair(blocks, bits):
    rng = random.Random(3)
    plan = simhash.coverings(blocks, bits)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for f in rng.sample(range(64), rng.randint(0, bits)):
            b ^= 1 << f
        x, y = np.array([a], np.uint64).view(np.int64), np.array([b], np.uint64).view(np.int64)
        assert any(c.homes(x)[0] in c.visits(y)[1] for c in plan)


def fingerprint_table(spark, fps):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    return spark.createDataFrame([(f,) for f in signed], "fp long")


@pytest.mark.parametrize(("group", "chunk", "visitors"), [(1 << 16, 8192, 1 << 16), (4, 16, 1 << 16), (4, 16, 64), (1 << 16, 8192, 32)])
def test_links_join_all_near_fingerprints(spark, monkeypatch, group, chunk, visitors):
    monkeypatch.setattr(simhash, "GROUP_PAIRS", group)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    monkeypatch.setattr(simhash, "HELD_ROWS", chunk + visitors)
    rng = random.Random(4)
    fps = {0}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(centre)
            for f in rng.sample(range(64), rng.randint(1, 4)):
                centre ^= 1 << f
    hot = rng.getrandbits(64)
    fps |= {hot ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    fps = sorted(fps)
    values = np.array(fps, np.uint64)
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 4).tolist()])
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    links = [(place[r.a], place[r.b]) for r in simhash.near_links(fingerprint_table(spark, fps).cache()).collect()]
    assert all(int(np.bitwise_count(values[a] ^ values[b])) <= 4 for a, b in links)
    assert components(len(fps), links) == want
    # Each group of an anchor reports a forest.
    assert len(links) <= (45 if chunk + visitors > 10**4 else 450) * len(fps)


def test_connected_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(300, links)
    assert got == {n: want[n] for n in {x for link in links if link[0] != link[1] for x in link}}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicate_documents(docs, rows, no_docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    values = np.array([slow_fingerprint(r[1] or "") for r in rows], np.uint64)
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 4).tolist()])
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[i][0])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((rows[i][0] or -1, least.get(c) or -1) for i, c in enumerate(comp))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values()))
    assert ids.count(None) == sum(c not in least for c in set(comp))
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []


def test_clashing_names_stay(docs, rows):
    extra = {"__near_id": 1, "__near": 2, "fp": 3, "n": 4, "lead": 5, "__near_hash": 6}
    table = docs.withColumns({k: F.lit(v) for k, v in extra.items()})
    out = simhash.keep_one(table)
    assert out.columns == table.columns
    got = out.collect()
    assert all(r[k] == v for r in got for k, v in extra.items())
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in simhash.keep_one(docs).collect())))


def vectors():
    rng = np.random.default_rng(8)
    out = []
    for _ in range(60):
        centre = rng.normal(size=16)
        out += [centre + 0.05 * rng.normal(size=16) for _ in range(int(rng.integers(1, 6)))]
    hot = rng.normal(size=16)
    out += [hot + 0.02 * rng.normal(size=16) for _ in range(150)]
    out = [[float(np.float32(x)) for x in v] for v in out]
    return [*out, out[0], out[0], [2 * x for x in out[1]]]


def test_embedding_links(spark):
    x = vectors()
    odd = [None, [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0], []]
    rows = [(i, v, "label") for i, v in enumerate(x + odd)] + [(None, x[2], "label")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    m = np.array([*x, x[2]])
    m = m / np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(1)
    n_found = sum(got[i].n_links for i in range(len(x)))
    assert n_found >= 0.98 * want[:-1].sum()
    assert all(got[i].n_links <= want[i] for i in range(len(x)))
    comp = components(len(m), list(zip(*np.nonzero(near), strict=True)))
    assert sum(got[i].component_id == comp[i] for i in range(len(x))) >= 0.98 * len(x)
    at = len(x)
    for i in (0, 1, 2, 3, 4, 7):
        assert (got[at + i].n_links, got[at + i].component_id, got[at + i].kept) == (0, at + i, True)
    assert got[at + 5].n_links == 1 and got[at + 6].component_id == at + 5
    assert not got[None].kept


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_on_planted_clusters(spark, monkeypatch):
    """9000 vectors in clusters of all sizes up to a third of them, spread over shards, against all pairs."""
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 1500)  # more than are compared whole
    assert embeddings.WHOLE_ROWS < 1400
    rng = np.random.default_rng(14)
    sizes = [3000, 300, 100, *[2] * 200, *[3] * 100, *[8] * 60]
    parts = [c + s * rng.normal(size=(n, 48)) / np.sqrt(48) for n in sizes for c, s in [(rng.normal(size=48) / np.sqrt(48), rng.choice([0.1, 0.25, 0.33]))]]
    x = np.concatenate([*parts, rng.normal(size=(9000 - sum(sizes), 48))]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    m = x.astype(np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    want, n = near.sum(1), np.array([got[i].n_links for i in range(len(x))])
    assert len(got) == len(x) and (n <= want).all() and want.sum() > 1_000_000
    assert n.sum() >= 0.98 * want.sum()
    rare = (want > 0) & (want < 10)
    assert rare.sum() > 500 and n[rare].sum() >= 0.98 * want[rare].sum()
    comp = components(len(x), list(zip(*np.nonzero(np.triu(near)), strict=True)))
    assert sum(got[i].component_id == comp[i] for i in range(len(x))) >= 0.995 * len(x)
    recall = embeddings.audited_recall(embeddings.found_between(embeddings.usable_vectors(table).cache())[1])
    assert recall is not None and recall >= embeddings.MIN_RECALL


def test_pairs_by_number():
    for n in (1, 2, 3, 7, 50):
        assert [embeddings.pair_at(k, n) for k in range(n * (n + 1) // 2)] == [(i, j) for i in range(n) for j in range(i, n)]
    n = 20_000_000
    assert embeddings.pair_at(0, n) == (0, 0) and embeddings.pair_at(n * (n + 1) // 2 - 1, n) == (n - 1, n - 1) and embeddings.pair_at(n, n) == (1, 1)


def test_shards_are_bounded_in_rows_and_bytes():
    assert embeddings.shard_count(0, 0) == embeddings.MIN_SHARDS
    assert embeddings.shard_count(10**9, 64 * 10**9) == 20_000
    assert 10**6 / embeddings.shard_count(10**6, 1024 * 10**6) * 1024 * embeddings.COMPONENT_BYTES <= embeddings.SHARD_BYTES


def test_long_vectors_in_many_shards(spark, monkeypatch):
    """1,024 components, more shards than rows alone would give, several pairs a task, two lengths: links as by brute force."""
    monkeypatch.setattr(embeddings, "SHARD_BYTES", 100 * 1024 * embeddings.COMPONENT_BYTES)
    monkeypatch.setattr(embeddings, "PAIR_TASKS", 5)
    rng = np.random.default_rng(6)
    x = [v for _ in range(200) for c in [rng.normal(size=1024)] for v in (c, c + 0.3 * rng.normal(size=1024), c + 0.6 * rng.normal(size=1024), rng.normal(size=1024))]
    x += [v[:700] for v in x[:90]]
    assert embeddings.shard_count(len(x), sum(map(len, x))) > embeddings.MIN_SHARDS
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()}
    near = []
    for low, high in ((0, 800), (800, len(x))):
        m = np.array(x[low:high])
        m /= np.linalg.norm(m, axis=1)[:, None]
        near += [(low + i, low + j) for i, j in zip(*np.nonzero(np.triu(m @ m.T >= 0.9, 1)), strict=True)]
    want = np.bincount(np.array(near).ravel(), minlength=len(x))
    comp = components(len(x), near)
    assert want.sum() > 400 and got == {i: (want[i], comp[i]) for i in range(len(x))}


def test_double_precision_is_kept(spark):
    """Components beyond single precision, and pairs that only double precision tells from 0.9."""
    a = [1.0, 0.0, 0.0]
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [2e200, 1e190]), (4, [1e-310, 1e-312]), (5, a), (6, [0.9 + 1e-12, (1 - (0.9 + 1e-12) ** 2) ** 0.5, 0.0]), (7, [0.9 - 1e-12, 0.0, (1 - (0.9 - 1e-12) ** 2) ** 0.5])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in (1, 2, 3, 4)] == [3, 3, 3, 3]
    assert (got[5].n_links, got[6].n_links, got[7].n_links) == (1, 1, 0)


def test_planted_queries_and_lost_nodes():
    """Planted queries are linked to their nodes; a node cut off from its graph is found by comparison."""
    rng = np.random.default_rng(3)
    u = embeddings._unit(rng.normal(size=(1500, 32)))
    g = embeddings.SmallWorld.build(u)
    made = g.planted(0.9)
    best = (made @ u.T).max(1)
    assert len(made) == embeddings.AUDITS and (best >= 0.9).all() and (best < 0.96).all() and np.allclose(np.linalg.norm(made, axis=1), 1, atol=1e-5)
    before = set(g.lost().tolist())
    cut = embeddings.SmallWorld(u, [np.where(np.isin(x, [7, 8]), -1, x) for x in g.layers], 0)
    assert set(cut.lost().tolist()) >= {7, 8} and len(before) < 15
    tiny = embeddings.SmallWorld.build(u[:1])
    assert [(at, r.tolist(), c.tolist()) for at, r, c, _ in tiny.within(u[:2], 0.9)] == [(0, [0], [0])]


def test_graph_recall():
    rng = np.random.default_rng(2)
    u = embeddings._unit(rng.normal(size=(1500, 24)))
    g = embeddings.SmallWorld.build(u)
    near = g.query(u[:200], 40)[0][:, :5]
    true = np.argsort(-(u[:200] @ u.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(near.tolist(), true.tolist(), strict=True)]) / 5 > 0.9


def all_links(a, b, least):
    return a @ b.T >= least


def test_sparse_links_are_all_found():
    """Twelve links between two shards, and a graph that leads to none of their ends: audits that see no link prove nothing."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(5000, 48))
    a = embeddings._unit(centre[:4000])
    b = embeddings._unit(np.concatenate([centre[1:13] + 0.1 * rng.normal(size=(12, 48)), rng.normal(size=(3988, 48))]))
    b = b[rng.permutation(len(b))]
    one, two = embeddings.SmallWorld.build(a), embeddings.SmallWorld.build(b)
    want = all_links(a, b, 0.9)
    assert want.sum() >= 12
    for layer in two.layers:
        layer[np.isin(layer, np.flatnonzero(want.any(0)))] = -1
    assert len(two.near(a[:256], 0.9, embeddings.BEAM)[0]) < want[:256].sum() == 12
    got = np.unpackbits(embeddings.found_links(one, two, 0.9), axis=1, count=len(b)).astype(bool)
    assert (got == want).all()


def test_beams_pass_audits_on_links_to_others_only():
    """Every node finds itself; half the nodes have one twin. Links count from both ends."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 48))
    u = embeddings._unit(np.concatenate([x, x[:1500] + 0.1 * rng.normal(size=(1500, 48))])[rng.permutation(4500)])
    g = embeddings.SmallWorld.build(u)
    got = np.unpackbits(embeddings.found_links(g, g, 0.9), axis=1, count=len(u)).astype(bool)
    want = all_links(u, u, 0.9)
    np.fill_diagonal(got, False)
    np.fill_diagonal(want, False)
    assert (got == got.T).all()
    assert (got & want).sum() >= 0.98 * want.sum()
