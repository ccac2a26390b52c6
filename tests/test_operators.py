"""Operators against hand-worked values, independent numpy versions and invariants."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skymill.config import RenderConfig
from skymill.functions import colour, cosmology, kernels, sql
from skymill.operators import deposit, frames, interpolate, levels, neighbours, octree, select, slabs, smoothing, tree
from skymill.plans import queries
from skymill.schema import AXES, minimum_image, wrap_position

XYZ = "id long, ptype int, x double, y double, z double"


def cloud(spark, n=300, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    p = rng.random((n, 3)) * spread
    return p, spark.createDataFrame([(i, i % 6, *map(float, v)) for i, v in enumerate(p)], XYZ)


def value(spark, column):
    return spark.range(1).select(column.cast("double")).first()[0]


def test_cic_of_a_central_particle(spark):
    one = spark.createDataFrame([(0, 1, 0.5, 0.5, 0.5)], XYZ)
    got = {(r.iy, r.ix): r.rho for r in deposit.cic_map(one, 4, 4, (0.5, 0.5), 1.0).collect()}
    assert got == {(1, 1): 4.0, (1, 2): 4.0, (2, 1): 4.0, (2, 2): 4.0}


@pytest.mark.parametrize("partitions", [1, 7])
def test_cic_conserves_mass_and_equals_numpy(spark, partitions):
    p, df = cloud(spark)
    n, image = 16, np.zeros((16, 16))
    inside = df.filter("x > 0.05 and x < 0.95 and y > 0.05 and y < 0.95").repartition(partitions)
    q = p[(p[:, 0] > 0.05) & (p[:, 0] < 0.95) & (p[:, 1] > 0.05) & (p[:, 1] < 0.95)]
    for x, y, _ in q * n:
        i, j = math.floor(x - 0.5), math.floor(y - 0.5)
        tx, ty = x - i - 0.5, y - j - 0.5
        for dy, wy in ((0, 1 - ty), (1, ty)):
            for dx, wx in ((0, 1 - tx), (1, tx)):
                image[j + dy, i + dx] += wx * wy * n * n
    got = np.zeros((n, n))
    for r in deposit.cic_map(inside, n, n, (0.5, 0.5), 1.0).collect():
        got[r.iy, r.ix] = r.rho
    assert np.allclose(got, image) and math.isclose(got.sum(), len(q) * n * n)


def test_selection_is_strict_and_periodic(spark):
    rows = [(i, 0, x, 0.5, 0.5) for i, x in enumerate([0.25, 0.2501, 0.7499, 0.75])]
    df = spark.createDataFrame(rows, XYZ)
    assert [r.id for r in df.filter(select.cube_filter((0.5, 0.5, 0.5), 0.5, 1.0)).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in df.filter(select.cube_filter((0.5, 0.5, 0.5), 0.5, 1.0)).orderBy("id").collect()] == [1, 2]
    edge = spark.createDataFrame([(0, 0, 0.98, 0.5, 0.5), (1, 0, 0.2, 0.5, 0.5)], XYZ)
    kept = edge.filter(select.cube_filter((0.05, 0.5, 0.5), 0.2, 1.0))
    assert [r.id for r in kept.collect()] == [0]
    assert math.isclose(select.unwrap_to_view(kept, (0.05, 0.5, 0.5), 1.0).first().x, -0.02)
    with pytest.raises(ValueError):
        select.cube_filter((0, 0, 0), 0, 1.0)


def test_filters_reach_the_scan(spark, tmp_path):
    _, df = cloud(spark)
    df.write.parquet(str(tmp_path / "p.parquet"))
    seen = select.select_view(spark.read.parquet(str(tmp_path / "p.parquet")), 0b101, (0.5, 0.5, 0.5), 0.2, 1.0).select("x", "y")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "In(ptype" in plan and "GreaterThanOrEqual(x" in plan


def test_types(spark):
    _, df = cloud(spark, 60)
    assert [r.ptype for r in select.missing_types(df.filter("ptype <> 2"), 0b1000101).orderBy("ptype").collect()] == [2, 6]
    assert {r.ptype: (r.first_row, r.end_row) for r in select.type_boundaries(df).collect()} == {t: (10 * t, 10 * t + 10) for t in range(6)}


@pytest.mark.parametrize(("d", "want"), [(0.1 - 0.9, 0.2), (0.9 - 0.1, -0.2), (0.5, 0.5)])
def test_minimum_image(spark, d, want):
    assert math.isclose(value(spark, minimum_image(F.lit(d), 1.0)), want)


def test_wrap(spark):
    assert [value(spark, wrap_position(F.lit(x), 1.0)) for x in (-0.25, 1.25, 1.0, 0.0)] == [0.75, 0.25, 0.0, 0.0]


def snaps(spark, **x):
    return {k: spark.createDataFrame([(i, 0, v, v, v) for i, v in enumerate(vs) if v is not None], XYZ) for k, vs in x.items()}


def test_hermite_is_linear_between_nearest_images(spark):
    s = snaps(spark, a=[0.9, 0.2, 0.5], b=[0.1, 0.3, None])
    got = interpolate.hermite(interpolate.match_by_id(s["a"], b=s["b"]), F.lit(0.25), 1.0).orderBy("id").collect()
    assert np.allclose([r.x for r in got], [0.95, 0.225, 0.5])
    for t, want in ((0.0, [0.9, 0.2, 0.5]), (1.0, [0.1, 0.3, 0.5])):
        got = interpolate.hermite(interpolate.match_by_id(s["a"], b=s["b"]), F.lit(t), 1.0).orderBy("id").collect()
        assert np.allclose([r.y for r in got], want)


def test_duplicate_ids_do_not_multiply_rows(spark):
    s = snaps(spark, a=[0.1, 0.2], b=[0.2, 0.3])
    assert interpolate.match_by_id(s["a"], b=s["b"].union(s["b"])).count() == 2


def test_catmull_rom_passes_through_both_ends(spark):
    s = snaps(spark, p=[0.95, None], a=[0.05, 0.4], b=[0.1, 0.45], n=[0.2, None])
    m = interpolate.match_by_id(s["a"], p=s["p"], b=s["b"], n=s["n"])
    for t, want in ((0.0, [0.05, 0.4]), (1.0, [0.1, 0.45])):
        assert np.allclose([r.x for r in interpolate.catmull_rom(m, F.lit(t), 1.0, True).orderBy("id").collect()], want)
    mid = interpolate.catmull_rom(m, F.lit(0.5), 1.0, True).orderBy("id").first().x
    assert math.isclose(mid, 0.075 + 0.125 * (0.05 - 0.075))


def test_extrapolation(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 1.0, 0.0, -1.0)], "x double, y double, z double, vx double, vy double, vz double")
    assert tuple(interpolate.extrapolate(df, 0.5, 0.2).first())[:3] == (0.6, 0.5, 0.4)
    assert tuple(interpolate.extrapolate(df, 0.5).first())[:3] == (1.0, 0.5, 0.0)


def test_rotation(spark):
    one = spark.createDataFrame([(1.0, 0.0, 0.0, 90.0), (1.0, 0.0, 0.0, 360.0)], "x double, y double, z double, angle_deg double")
    got = frames.rotate(one, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)).orderBy("angle_deg").collect()
    assert np.allclose(got[0][:3], (0, 1, 0)) and np.allclose(got[1][:3], (1, 0, 0))
    p, df = cloud(spark, 50)
    turned = frames.rotate(df.withColumn("angle_deg", F.lit(33.0)), (0.5, 0.5, 0.5), frames.unit_vector(1, 2, 3)).orderBy("id").collect()
    q = np.array([[r.x, r.y, r.z] for r in turned])
    assert np.allclose(np.linalg.norm(q - 0.5, axis=1), np.linalg.norm(p - 0.5, axis=1))


def test_frames(spark):
    got = frames.frames_table(spark, RenderConfig(zoom=3, zoom_factor=0.5, lbox=2.0)).orderBy("frame").collect()
    assert [r.lbox for r in got] == [2.0, 1.0, 0.5]
    got = frames.frames_table(spark, RenderConfig(snap_a="a", snap_b="b", itmax=5, lbox=1.0, rot_dangle=10)).orderBy("frame").collect()
    assert [r.t for r in got] == [0, 0.25, 0.5, 0.75, 1.0] and got[4].angle_deg == 40


@pytest.mark.parametrize(("snaps_", "n", "mode", "total"), [(4, 9, "hermite", 25), (4, 9, "catmull", 17), (5, 9, "catmull4", 17), (10, 25, "hermite", 217)])
def test_frame_totals(spark, snaps_, n, mode, total):
    table = spark.range(snaps_).select(F.col("id").cast("int").alias("seq"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("root"))
    got = frames.global_frames(frames.snapshot_roles(table, mode), n).orderBy("global_frame").collect()
    assert frames.frame_total(snaps_, n, mode) == total == len(got)
    assert [r.global_frame for r in got] == list(range(total)) and got[-1].file == f"frame.{total - 1:04d}.png"


@pytest.mark.parametrize(("u", "want"), [(0, 2.5464790895), (0.25, 1.8302818456), (0.5, 0.6366197724), (0.75, 0.0795774715), (1, 0)])
def test_spline_3d(spark, u, want):
    assert math.isclose(value(spark, kernels.spline_3d(F.lit(float(u)))), want, abs_tol=1e-9)


@pytest.mark.parametrize(("q", "want"), [(0, 0.4773839775), (0.5, 0.3387163010), (1, 0.1110360600), (1.5, 0.0114423170), (2, 0)])
def test_projected(spark, q, want):
    assert math.isclose(value(spark, kernels.projected(F.lit(float(q)))), want, abs_tol=1e-9)


@pytest.mark.parametrize(("u", "want"), [(0, 0), (0.5, 0.1429907692), (1, 0.2188380468), (1.5, 0.2374890166), (2, 0.2387324146), (3, 0.2387324146)])
def test_cumulative(spark, u, want):
    assert math.isclose(value(spark, kernels.cumulative(F.lit(float(u)))), want, abs_tol=1e-9)


def test_lookup_interpolates(spark):
    assert math.isclose(value(spark, kernels.lookup([0.0, 1.0, 4.0], 2.0, F.lit(1.5))), 2.5)
    assert value(spark, kernels.lookup([1.0, 1.0], 2.0, F.lit(2.0))) == 0


@pytest.mark.parametrize("compat", [False, True])
def test_particles_beyond_the_image_change_nothing(spark, compat):
    """They are left out before they are summed; those at the edge still reach its pixels."""
    rng = np.random.default_rng(6)
    p = rng.uniform(-1, 2, (400, 2))
    df = spark.createDataFrame([(*map(float, v), k) for k in (0, 1) for v in p], "x double, y double, frame int").withColumn("lbox", F.lit(0.5) / (F.col("frame") + 1))
    got = {(r.frame, r.iy, r.ix): r.rho for r in deposit.cic_map(df, 8, 6, (0.5, 0.5), F.col("lbox"), ("frame",), compat).collect()}
    want = {}
    for frame in (0, 1):
        lbox = 0.5 / (frame + 1)
        for x, y in p:
            px, py = (x - 0.5) * 8 / lbox + 4, (y - 0.5) * 6 / lbox + 3
            for dy in (0, 1):
                for dx in (0, 1):
                    iy, ix = math.floor(py - 0.5) + dy, math.floor(px - 0.5) + dx
                    w = max(0, 1 - abs(px - ix - 0.5)) * max(0, 1 - abs(py - iy - 0.5)) * 48 / lbox**2
                    if 0 <= ix < 8 and (iy >= -6 if compat else 0 <= iy < 6):
                        want[frame, (iy + 6) % 6, ix] = want.get((frame, (iy + 6) % 6, ix), 0) + w
    assert {k for k, v in got.items() if v > 1e-9} == {k for k, v in want.items() if v > 1e-9}
    assert all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9) for k, v in want.items() if v > 1e-9)


def test_kernel_of_arrays(spark):
    q2 = np.concatenate([np.linspace(0, 3.999999, 4001), [1.0, 1e-12, 0.9999999]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(q2)], "i int, q2 double")
    want = {r.i: r.w for r in df.select("i", kernels.projected_q2(F.col("q2")).alias("w")).collect()}
    assert np.allclose(kernels.projected_array(q2), [want[i] for i in range(len(q2))], rtol=0, atol=2e-12)


def kernel_sum(rows, width, height):
    """Every particle on every pixel: (key, iy, ix): rho."""
    out = {}
    for key, x, y, h, lbox in rows:
        h_px = h * width / lbox
        if not h or h_px > 16:
            continue
        h_px = min(h_px, 8.0)
        px, py = (x - 0.5) * width / lbox + width / 2, (y - 0.5) * height / lbox + height / 2
        iy, ix = np.indices((height, width))
        q2 = ((ix + 0.5 - px) ** 2 + (iy + 0.5 - py) ** 2) / h_px**2
        r = int(np.ceil(2 * h_px))
        near = (q2 < 4) & (abs(ix - int(px)) <= r) & (abs(iy - int(py)) <= r)
        value = kernels.projected_array(q2[near]) / h_px**2 * width * height / lbox**2
        for j, i, v in zip(iy[near].tolist(), ix[near].tolist(), value.tolist(), strict=True):
            out[key, j, i] = out.get((key, j, i), 0.0) + v
    return out


@pytest.mark.parametrize("part_rows", [1 << 22, 7])
def test_sph_map_equals_every_kernel_on_every_pixel(spark, part_rows):
    """In whole strips and in strips that several tasks share; images of several strips, particles beyond the edges, null keys, a hot place."""
    rng = np.random.default_rng(8)
    rows = [(int(k), float(x), float(y), float(h), 1.0 + 0.5 * int(k)) for k, x, y, h in zip(rng.integers(0, 2, 150), rng.uniform(-0.2, 1.2, 150), rng.uniform(-0.2, 1.2, 150), rng.uniform(0.001, 0.2, 150), strict=True)]
    rows += [(1, 0.5, 0.51, 0.01, 1.5)] * 60 + [(None, 0.3, 0.3, 0.05, 1.0)] * 9 + [(0, 0.5, 0.5, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, x double, y double, h double, lbox double").repartition(3)
    got = {(r.frame, r.iy, r.ix): r.rho for r in deposit.sph_map(df, 40, 130, (0.5, 0.5), F.col("lbox"), ("frame",), part_rows=part_rows).collect()}
    want = kernel_sum(rows, 40, 130)
    assert all(math.isclose(got.get(k, 0.0), v, rel_tol=1e-6, abs_tol=1e-9) for k, v in want.items())
    assert set(got) <= set(want) and len(got) > 5000


def test_pixels_of_strips_are_not_shuffled(spark):
    """One exchange, of particles, below the sums; a shared strip adds one of pixels."""
    df = spark.range(2000).select(*[F.rand(k).alias(c) for k, c in enumerate("xy")], F.lit(0.01).alias("h"))
    for part_rows, exchanges in ((1 << 22, 1), (50, 2)):
        plan = deposit.sph_map(df, 256, 256, (0.5, 0.5), 1.0, part_rows=part_rows)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("MapInArrow")]
        assert ("Aggregate" in above) == (exchanges == 2) and plan.count("RepartitionByExpression") == 1


def test_sph_mass(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.06)], "x double, y double, h double")
    total = deposit.sph_map(df, 64, 64, (0.5, 0.5), 1.0).agg(F.sum("rho")).first()[0]
    assert math.isclose(total / 64**2, 1, rel_tol=0.02)
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.2), (0.5, 0.5, 0.5, None), (0.5, 0.5, 0.5, 0.0)], "x double, y double, z double, h double")
    assert math.isclose(deposit.sph_grid(df, 32, (0.5,) * 3, 1.0).agg(F.sum("rho")).first()[0], 1, rel_tol=0.05)


@pytest.mark.parametrize(("spread", "k"), [(1.0, 8), (0.001, 3), (1.0, 400)])
def test_nearest_equals_brute_force(spark, spread, k):
    p, df = cloud(spark, 250, 2, spread)
    p[0] = p[1]
    df = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(np.concatenate([p, [[5.0, 5.0, 5.0]]]))], XYZ)
    q = np.concatenate([p, [[5.0, 5.0, 5.0]]])
    d2 = np.sort(((q[:, None] - q[None]) ** 2).sum(2), axis=1)
    got = {r.id: r for r in neighbours.nearest(df, k).collect()}
    n = min(k, len(q))
    assert len(got) == len(q) and all(got[i].n == n and math.isclose(got[i].r2, d2[i, n - 1], abs_tol=1e-12) for i in range(len(q)))


def points(spark, p):
    return spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(p)], XYZ)


def kth(q, p, k):
    d2 = np.sort(((q[:, None] - p[None]) ** 2).sum(2), axis=1)
    return d2[:, min(k, len(p)) - 1]


@pytest.mark.parametrize(("subtree", "group", "shared"), [(200_000, 128, 0), (300, 2, 0), (300, 128, 10**6)])
def test_nearest_of_clustered_points(spark, monkeypatch, subtree, group, shared):
    """A third of all points in one place, a tight cluster, a thin halo; in several rounds of range shuffles and groups, or given to all tasks."""
    monkeypatch.setattr(tree, "GROUP_LEAVES", group)
    monkeypatch.setattr(tree, "BROADCAST_POINTS", shared)
    rng = np.random.default_rng(8)
    p = np.concatenate([np.full((700, 3), 0.25), 0.6 + 1e-4 * rng.normal(size=(700, 3)), rng.random((600, 3)), 40 * rng.normal(size=(100, 3))])
    got = {r.id: r for r in tree.nearest(points(spark, p), 9, leaf_rows=16, subtree_rows=subtree).collect()}
    want = kth(p, p, 9)
    assert len(got) == len(p) and all(got[i].n == 9 and math.isclose(got[i].r2, want[i], rel_tol=1e-9, abs_tol=1e-15) for i in range(len(p)))
    q = np.concatenate([rng.random((150, 3)), 1000 + rng.random((5, 3)), p[:3]])
    got = {r.id: r for r in tree.nearest(points(spark, p), 9, points(spark, q), leaf_rows=16, subtree_rows=subtree).collect()}
    want = kth(q, p, 9)
    assert len(got) == len(q) and all(got[i].n == 9 and math.isclose(got[i].r2, want[i], rel_tol=1e-9, abs_tol=1e-15) for i in range(len(q)))


@pytest.mark.parametrize("shared", [0, 10**6])
def test_nearest_within_groups_of_all_sizes(spark, monkeypatch, shared):
    """A tree for each group, all as deep as the largest needs: the leaves of small ones hold fewer than k points."""
    monkeypatch.setattr(tree, "BROADCAST_POINTS", shared)
    rng = np.random.default_rng(10)
    sizes = {0: 900, 1: 40, 3: 9, 4: 5, 6: 60}
    p = {g: np.full((n, 3), 0.5) if g == 6 else rng.random((n, 3)) for g, n in sizes.items()}
    rows = [(i, *map(float, v), g) for g in p for i, v in enumerate(p[g])]
    got = {(r.g, r.id): (r.r2, r.n) for r in tree.nearest(spark.createDataFrame(rows, "id long, x double, y double, z double, g int"), 9, leaf_rows=16, group="g").collect()}
    assert len(got) == len(rows)
    for g in p:
        want = kth(p[g], p[g], 9)
        assert all(got[g, i][1] == min(9, len(want)) and math.isclose(got[g, i][0], w, rel_tol=1e-9, abs_tol=1e-15) for i, w in enumerate(want))


@pytest.mark.parametrize("shared", [0, 10**6])
def test_distant_queries_and_few_points(spark, monkeypatch, shared):
    monkeypatch.setattr(tree, "BROADCAST_POINTS", shared)
    p = np.array([[0.0, 0, 0], [1, 0, 0], [0, 2, 0]])
    q = points(spark, [[0.1, 0, 0], [1e6, 1e6, 1e6]])
    assert {r.id: r.n for r in neighbours.nearest(points(spark, p), 3, q).collect()} == {0: 3, 1: 3}
    got = {r.id: (r.n, r.r2) for r in neighbours.nearest(points(spark, p), 5, q).collect()}
    assert got[0][0] == got[1][0] == 3 and math.isclose(got[0][1], 4.01)
    none = points(spark, p).filter("id > 9")
    assert {(r.n, r.r2) for r in neighbours.nearest(none, 2, q).collect()} == {(0, None)}
    assert neighbours.nearest(points(spark, p), 2, none).collect() == []


def test_comparisons_within_a_radius(spark):
    """Separate queries, clusters and distant points, small leaves and several rounds; the edge of the radius belongs to it."""
    rng = np.random.default_rng(15)
    p = np.concatenate([np.full((40, 3), 0.5), 0.2 + 0.01 * rng.normal(size=(150, 3)), rng.random((200, 3)), [[0.0, 0.0, 0.0], [0.25, 0.0, 0.0]]])
    q = np.concatenate([rng.random((60, 3)), [[9.0, 9, 9], [0.0, 0.0, 0.0], [0.5, 0.5, 0.5]]])
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(d2 <= 0.0625)), strict=True))
    got = neighbours.radius_join(points(spark, q), points(spark, p), 0.25).collect()
    assert {(r.id, r.other) for r in got} == want and len(got) == len(want) and (61, 391) in want
    assert all(math.isclose(r.r2, d2[r.id, r.other], abs_tol=1e-12) for r in got)
    assert neighbours.radius_join(points(spark, q), points(spark, p).filter("id < 0"), 0.25).collect() == []
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) / 0.2
    w = 8 / math.pi * np.where(near < 0.5, 6 * near * near * (near - 1) + 1, np.where(near < 1, 2 * (1 - near) ** 3, 0)) / 0.2**3
    density = {r.id: r.density for r in neighbours.kernel_density(points(spark, p), 0.2).collect()}
    assert len(density) == len(p) and all(math.isclose(density[i], v, rel_tol=1e-9) for i, v in enumerate(w.sum(1)))


def test_density_weighs_masses(spark):
    p, df = cloud(spark, 90, 12)
    r = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) / 0.3
    w = 8 / math.pi * np.where(r < 0.5, 6 * r * r * (r - 1) + 1, np.where(r < 1, 2 * (1 - r) ** 3, 0)) / 0.3**3
    got = {x.id: x.density for x in neighbours.kernel_density(df, 0.3, F.col("id") + 1.0).collect()}
    assert all(math.isclose(got[i], v, rel_tol=1e-9) for i, v in enumerate(w @ np.arange(1, 91)))


def test_radius_and_density(spark):
    p, df = cloud(spark, 120, 3)
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    got = {(r.id, r.other) for r in neighbours.radius_join(df, df, 0.2).collect()}
    assert got == set(zip(*map(list, np.nonzero(d2 <= 0.04)), strict=True))
    assert neighbours.nth_neighbour(df, 500).filter("distance <> -1").count() == 0


def test_leaves_halve_and_stay_small(spark):
    p, df = cloud(spark, 1000, 4)
    got = smoothing.leaves(df, 32, subtree_rows=260).collect()
    sizes = {}
    for r in got:
        sizes[r.node, r.leaf] = sizes.get((r.node, r.leaf), 0) + 1
    assert len(got) == 1000 and max(sizes.values()) <= 32 and min(sizes.values()) >= 15
    whole = tree.leaf_numbers(p, np.arange(1000), 32)
    groups = {}
    for r in got:
        groups.setdefault((r.node, r.leaf), set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == {frozenset(np.flatnonzero(whole == k).tolist()) for k in range(whole.max() + 1)}


def test_leaf_lengths_follow_density(spark):
    _, df = cloud(spark, 800, 5)
    h = [r.h for r in smoothing.leaf_lengths(df, 1.0, 8).collect()]
    exact = [r.h for r in smoothing.knn_lengths(df, 1.0, 8).collect()]
    assert len(h) == len(exact) == 800 and 0.5 < np.mean(h) / np.mean(exact) < 1.5


def test_grid_lengths_and_empty(spark):
    _, df = cloud(spark, 500, 6)
    assert smoothing.grid_lengths(df, 100.0, n=8).filter("h > 0").count() > 400
    assert smoothing.grid_lengths(df.filter("id < 0"), 1.0).count() == 0


def test_lengths_are_kept(spark, tmp_path):
    _, df = cloud(spark, 100, 7)
    one = smoothing.cached_lengths(df, str(tmp_path), "leaf", 1.0, 64).orderBy("id").collect()
    again = smoothing.cached_lengths(df, str(tmp_path), "leaf", 1.0, 64).orderBy("id").collect()
    assert one == again and len(list(tmp_path.iterdir())) == 1
    smoothing.cached_lengths(df.filter("id > 3"), str(tmp_path), "leaf", 1.0, 64)
    assert len(list(tmp_path.iterdir())) == 2


def pixels(spark, rows):
    return spark.createDataFrame([(0, iy, ix, float(v)) for iy, ix, v in rows], "frame int, iy int, ix int, rho double")


def test_levels(spark):
    got = levels.auto_levels(pixels(spark, [(0, i, 10.0**i) for i in range(10)])).first()
    assert (got.vmin, got.vmax) == (0, 9)
    got = levels.auto_levels(pixels(spark, [(0, 0, 1000.0)])).first()
    assert math.isclose(got.vmin, 3) and math.isclose(got.vmax, 3.01)
    assert math.isclose(value(spark, levels.noise_floor(F.lit(1.0))), 0.001)


@pytest.mark.parametrize(("lo", "hi"), [(0.1, 1.0), (0.0, 0.5), (0.37, 0.371), (1.0, 1.0)])
def test_levels_by_bins_equal_sorted_ones(spark, monkeypatch, lo, hi):
    """Ties, one value only, values over many magnitudes, and few bins, so that several rounds are needed."""
    monkeypatch.setattr(levels, "BINS", 4)
    rng = np.random.default_rng(3)
    frames = [rng.random(200), np.full(50, 7.0), 10.0 ** rng.uniform(-30, 30, 150), np.concatenate([np.full(99, 1.0), [1e9]]), [5.0], [0.0, 3.0]]
    rows = [(f, 0, i, float(v)) for f, values in enumerate(frames) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "frame int, iy int, ix int, rho double")
    a, b = (sorted(map(tuple, levels.auto_levels(df, True, lo, hi, most=m).collect())) for m in (10**6, None))
    assert a == b and len(a) == len(frames)
    assert levels.auto_levels(df.filter("frame > 90"), True, lo, hi).collect() == []


def test_grids_as_arrays_equal_tables(spark, monkeypatch):
    rng = np.random.default_rng(16)
    df = points(spark, np.concatenate([rng.random((400, 3)), 0.3 + 0.01 * rng.normal(size=(300, 3)), [[0.0, 0, 0], [1, 1, 1]]])).repartition(3)
    for n in (1, 2, 9):
        dense = {r.id: r.h for r in smoothing.grid_lengths(df, 60.0, n).collect()}
        monkeypatch.setattr(smoothing, "DENSE_CELLS", 0)
        table = {r.id: r.h for r in smoothing.grid_lengths(df, 60.0, n).collect()}
        monkeypatch.undo()
        assert dense.keys() == table.keys() and len(dense) == 702
        assert all((dense[i] is None) == (h is None) and (h is None or math.isclose(dense[i], h, rel_tol=1e-9)) for i, h in table.items())
    assert any(h is None for h in dense.values())


@pytest.mark.parametrize("method", ["grid", "leaf", "knn"])
def test_lengths_of_groups_equal_those_alone(spark, method):
    p, df = cloud(spark, 300, 9)
    df = df.withColumn("frame", F.when(F.col("id") < 100, 0).when(F.col("id") < 260, 1).otherwise(5))
    df = df.withColumn("x", F.col("x") * (F.col("frame") + 1)).unionByName(df.filter("id < 40").withColumn("frame", F.lit(2)))
    options = {"num_ngb": 6} | ({"n": 8} if method == "grid" else {"subtree_rows": 50} if method == "leaf" else {})
    got = {(r.frame, r.id): r.h for r in smoothing.smoothing_lengths(df, method, 50.0, 64, group="frame", **options).collect()}
    want = {}
    for frame in (0, 1, 2, 5):
        want |= {(frame, r.id): r.h for r in smoothing.smoothing_lengths(df.filter(F.col("frame") == frame), method, 50.0, 64, **options).collect()}
    assert got.keys() == want.keys() and len(got) == 340
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or math.isclose(got[k], want[k], rel_tol=1e-9)) for k in want)


def slow_fill(image, passes):
    for _ in range(passes):
        out, changed = image.copy(), False
        for y in range(1, len(image) - 1):
            for x in range(1, len(image[0]) - 1):
                near = image[y - 1 : y + 2, x - 1 : x + 2]
                if image[y, x] <= 0 and (near > 0).any():
                    out[y, x], changed = near[near > 0].mean(), True
        image = out
        if not changed:
            break
    return image


def test_fill_small(spark):
    got = {(r.iy, r.ix): r.rho for r in levels.fill_holes(pixels(spark, [(2, 2, 9)]), 5, 5).collect()}
    assert got == {(y, x): 9.0 for y in (1, 2, 3) for x in (1, 2, 3)}


@pytest.mark.parametrize(("passes", "tile"), [(64, 512), (3, 8), (2, 5)])
def test_fill_in_tiles_equals_whole_image(spark, passes, tile):
    rng = random.Random(8)
    image = np.zeros((23, 31))
    for _ in range(14):
        image[rng.randrange(23), rng.randrange(31)] = rng.random() + 0.1
    rows = [(int(y), int(x), image[y, x]) for y, x in zip(*np.nonzero(image), strict=True)]
    got = np.zeros_like(image)
    for r in levels.fill_holes(pixels(spark, rows), 31, 23, passes, tile).collect():
        got[r.iy, r.ix] = r.rho
    assert np.allclose(got, slow_fill(image, passes))


def test_densify(spark):
    frames_ = spark.createDataFrame([(0,), (1,)], "frame int")
    got = levels.densify(pixels(spark, [(1, 1, 5)]), frames_, 3, 2)
    assert got.count() == 12 and got.agg(F.sum("rho")).first()[0] == 5


def test_normalise(spark):
    lo, hi = F.lit(0.0), F.lit(2.0)
    assert [value(spark, colour.normalise(F.lit(x), lo, hi, True)) for x in (10.0, 0.0, 1e5)] == [0.5, 0, 1]


@pytest.mark.parametrize(("t", "want"), [(0, 0), (0.25, 0.5118833610), (0.5, 0.7403626895), (1, 1)])
def test_log_opacity(spark, t, want):
    assert math.isclose(value(spark, colour.opacity(F.lit(float(t)), "log")), want, abs_tol=1e-9)


def test_composite(spark):
    c = colour.composite((F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(0.5), (0, 0, 0, 1))
    assert tuple(spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()) == (128, 0, 0, 255)
    clear = colour.composite((F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(0.0), (0, 0, 0, 0))
    assert tuple(spark.range(1).select(*[v.alias(k) for k, v in clear.items()]).first()) == (0, 0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 1), st.sampled_from(["hot", "fire", "ice", "magma", "viridis", "coolwarm", "grayscale", "plasma", "inferno"]))
def test_palettes_stay_in_range(u, name):
    assert all(-1e-12 <= c <= 1 + 1e-12 for c in colour.between(colour.stops_of(name), u))


def test_palettes():
    assert colour.palette_rows("hot")[0] == (0, 0, 0) and colour.palette_rows("hot")[255] == (1, 1, 1)
    assert len(colour.palette_rows("magma")) == 256 and colour.palette_rows("viridis")[64] == (0.229739, 0.322361, 0.545706)


def test_palette_file(tmp_path):
    f = tmp_path / "p.txt"
    f.write_text("# pos r g b\n1 1 1 1\n0 0 0 0 # low\n")
    assert colour.load_stops(str(f)) == [(0, 0, 0, 0), (1, 1, 1, 1)]
    f.write_text("0 0 0 0\n")
    with pytest.raises(ValueError):
        colour.load_stops(str(f))
    assert colour.between([], 0.3) == (0.3, 0.3, 0.3)


def test_slabs(spark):
    df = spark.createDataFrame([(i / 8 + 0.01,) for i in range(8)], "x double")
    splits = slabs.slab_splits(slabs.slab_histogram(df, 0.0, 1.0), 2, 0.0, 1.0).orderBy("slab").collect()
    assert splits[0].end_bin == int((3 / 8 + 0.01) * 8192) + 1 and splits[1].hi == 1.0
    counts = [r.n for r in slabs.assign_slabs(df, slabs.slab_splits(slabs.slab_histogram(df, 0.0, 1.0), 2, 0.0, 1.0)).groupBy("slab").agg(F.count("*").alias("n")).orderBy("slab").collect()]
    assert counts == [4, 4]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 3000])
def test_many_slabs(spark, n):
    """Ends belong to the next slab; below all is the first, beyond all or nowhere the last."""
    ends = np.arange(1, n + 1) / n
    splits = spark.createDataFrame([(i, float(e)) for i, e in enumerate(ends)], "slab int, hi double")
    xs = [-1.0, 0.0, 2.0, float("nan"), None, *np.random.default_rng(n).random(200).tolist(), *ends[:: max(1, n // 50)].tolist()]
    got = {(r.i, r.slab) for r in slabs.assign_slabs(spark.createDataFrame(list(enumerate(xs)), "i int, x double"), splits).collect()}
    assert got == {(i, n - 1 if x is None or x != x else min(int(np.searchsorted(ends, x, "right")), n - 1)) for i, x in enumerate(xs)}


def test_interval(spark):
    got = cosmology.snapshot_interval(spark, 0.5, 0.52, h=0.6774).first()
    assert math.isclose(got.snap_dt, 2.256318e-4, rel_tol=1e-6) and math.isclose(got.dt_gyr, 0.325688, rel_tol=1e-5)
    with pytest.raises(ValueError):
        cosmology.snapshot_interval(spark, 0.5, 0.4)


def test_opened_cells_grow_as_the_angle_shrinks(spark):
    _, df = cloud(spark, 60, 9)
    wide, narrow = (neighbours.opened_cells(df, 1.0, 3, t).agg(F.sum("n_cells")).first()[0] for t in (2.0, 0.3))
    assert narrow > wide


def test_sql_functions_equal_columns(spark):
    from skymill.functions.sql import register_functions

    register_functions(spark)
    spark.range(41).select((F.col("id") / 16.0 - 0.2).alias("u")).createOrReplaceTempView("u_values")
    got = spark.sql("SELECT u, spline_3d(abs(u)) AS a, spline_projected(abs(u)) AS b, wrap_position(u, 1) AS c, minimum_image(u, 1) AS d, density_normalise(u, -1, 1) AS e, opacity_log(u) AS f, opacity_power(u, 2) AS g FROM u_values")
    u = F.abs("u")
    want = spark.table("u_values").select(
        "u", kernels.spline_3d(u).alias("a"), kernels.projected(u).alias("b"), wrap_position(F.col("u"), 1.0).alias("c"), minimum_image(F.col("u"), 1.0).alias("d"), colour.normalise(F.col("u"), F.lit(-1.0), F.lit(1.0), True).alias("e"),
        colour.opacity(F.col("u"), "log").alias("f"), colour.opacity(F.col("u"), "power").alias("g"),
    )
    assert np.allclose(np.array(got.orderBy("u").collect(), float), np.array(want.orderBy("u").collect(), float))
    assert spark.sql("SELECT box_distance2(2, 0.5, -1, 0, 0, 0, 1, 1, 1)").first()[0] == 2


#: Rows of the two tabulated palettes.
TABLE_ROWS = {
    "viridis": {1: (0.268510, 0.009605, 0.335427), 2: (0.269944, 0.014625, 0.341379), 6: (0.274952, 0.037752, 0.364543), 20: (0.283197, 0.115680, 0.436115), 36: (0.275191, 0.194905, 0.496005), 250: (0.945636, 0.899815, 0.039907), 253: (0.974417, 0.903590, 0.029363)},
    "magma": {1: (0.002258, 0.001295, 0.018331), 3: (0.004512, 0.003490, 0.029965), 18: (0.048062, 0.036607, 0.150327), 42: (0.171713, 0.067305, 0.370771), 60: (0.291366, 0.064553, 0.475462), 210: (0.967317, 0.641305, 0.162785), 250: (0.849625, 0.918303, 0.007967), 254: (0.837124, 0.937642, 0.0), 255: (0.997257, 0.999892, 0.749423)},
}


@pytest.mark.parametrize("name", sorted(TABLE_ROWS))
def test_tabulated_palettes(name):
    """As tabulated."""
    rows = colour.palette_rows(name)
    assert len(rows) == 256 and all(0 <= c <= 1 for r in rows for c in r)
    for i, want in TABLE_ROWS[name].items():
        assert rows[i] == want, i


def test_octree_of_one_place_and_of_a_line(spark):
    """Equal points are split down to the given depth and no further; an axis without extent has one cell."""
    same = points(spark, [[0.5, 0.5, 0.5]] * 20)
    tree = {r.path: r for r in octree.numbered(octree.nodes(same, depth=3)).collect()}
    assert sorted(tree) == ["", "0", "00", "000"] and all(r.n == 20 for r in tree.values())
    assert [tree[p].split for p in ("", "0", "00", "000")] == [True, True, True, False]
    assert [tree[p]["index"] for p in ("", "0", "00", "000")] == [1, 2, 3, 4] and [tree[p].place for p in ("000", "00", "0", "")] == [0, 1, 2, 3]
    line = points(spark, [[i / 10, 0.0, 0.0] for i in range(11)])
    nodes = octree.nodes(line)
    assert {r.path: r.n for r in nodes.collect()} == {"": 11, "0": 6, "1": 5}
    got = {r.id: (r.path, r.n) for r in octree.node_of(points(spark, [[0.5, 0, 0], [0.51, 0, 0], [-9.0, 0, 0], [9.0, 0, 0]]), nodes).collect()}
    assert got == {0: ("0", 6), 1: ("1", 5), 2: ("0", 6), 3: ("1", 5)}
    assert {(r.n_leaves, r.n_members) for r in octree.leaves_near(points(spark, [[5.0, 5, 5]]), nodes, 0.1).collect()} == {(0, 0)}


def test_uniform_numbers(spark):
    draw = spark.range(0, 2000, 1, 2).select(sql.uniform(7).alias("u"))
    a = [r.u for r in draw.collect()]
    assert a == [r.u for r in draw.collect()] and all(0 <= u < 1 for u in a) and abs(np.mean(a) - 0.5) < 0.03


def test_nearest_across_blocks_counts_copies(spark):
    """Many copies of few places, a sparse halo, and blocks smaller than a distance to the k-th; points are never shuffled leaf by leaf."""
    rng = np.random.default_rng(21)
    few = rng.random((40, 3))
    p = np.concatenate([few[rng.integers(0, 40, 600)], rng.random((300, 3)), 20 * rng.normal(size=(30, 3)), np.full((200, 3), -0.0)])
    want = kth(p, p, 7)
    df = points(spark, p)
    got = {(r.x, r.y, r.z): r for r in tree.nearest_places(df, 7, block_rows=25).collect()}
    places, where, n = np.unique(p + 0.0, axis=0, return_inverse=True, return_counts=True)
    assert len(got) == len(places) and all(got[tuple(q)].copies == m for q, m in zip(places.tolist(), n.tolist(), strict=True))
    assert all(got[tuple(p[i] + 0.0)].n == 7 and math.isclose(got[tuple(p[i] + 0.0)].r2, want[i], rel_tol=1e-9, abs_tol=1e-15) for i in range(len(p)))
    by_id = {r.id: r.r2 for r in tree.nearest(df, 7, subtree_rows=25).collect()}
    assert all(math.isclose(by_id[i], want[i], rel_tol=1e-9, abs_tol=1e-15) for i in range(len(p)))
    odd = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, float("nan"), 0.0, 0.0), (2, 0, 1.0, None, 0.0), (3, 0, 0.0, 3.0, 4.0)], XYZ)
    assert {r.id: (r.n, r.r2) for r in tree.nearest(odd, 2).collect()} == {0: (2, 25.0), 1: (0, None), 2: (0, None), 3: (2, 25.0)}


def test_nth_neighbour_of_places(spark):
    """Rows without ids; copies are neighbours of each other."""
    df = spark.createDataFrame([(0.0, 0.0, 0.0)] * 5 + [(1.0, 0.0, 0.0), (3.0, 0.0, 0.0)], "x double, y double, z double")
    got = {r.x: (r.copies, r.distance) for r in neighbours.nth_neighbour_places(df, 5).collect()}
    assert got == {0.0: (5, 1.0), 1.0: (1, 1.0), 3.0: (1, 3.0)}
    assert {r.distance for r in neighbours.nth_neighbour_places(df, 7).collect()} == {-1.0}


def test_radius_in_blocks_that_stream(spark, monkeypatch):
    """More points than are given to every task: many blocks, copies, distant points, separate queries."""
    monkeypatch.setattr(tree, "BROADCAST_POINTS", 0)
    rng = np.random.default_rng(23)
    p = np.concatenate([np.full((60, 3), 0.5), rng.random((250, 3)), 5 * rng.normal(size=(20, 3)), 0.2 + 0.01 * rng.normal(size=(90, 3))])
    q = np.concatenate([rng.random((80, 3)), [[9.0, 9, 9]], p[:2]])

    def block(ids, a, others, b, w, d2):
        row, column = np.nonzero(d2 <= 0.04)
        return {"id": ids[row], "other": others[column]}

    for asked, x in ((points(spark, q), q), (None, p)):
        df = points(spark, p)
        got = sorted((r.id, r.other) for r in tree.compare_within(asked or df, df, 0.2, block, "id long, other long", leaf_rows=8, block_rows=40).collect())
        assert got == list(zip(*map(np.ndarray.tolist, np.nonzero(((x[:, None] - p[None]) ** 2).sum(2) <= 0.04)), strict=True))


@pytest.mark.parametrize("shared", [0, 1 << 20])
def test_pairs_with_rounded_distances(spark, monkeypatch, shared):
    """Copies, halves, distant points; distances that repeat, and some too fine for a number of a pair."""
    monkeypatch.setattr(tree, "BROADCAST_POINTS", shared)
    rng = np.random.default_rng(27)
    p = np.concatenate([np.full((60, 3), 0.5), rng.random((200, 3)), [[2.0, 0, 0], [2.25, 0.25, 0], [9.0, 9, 9]]])
    q = np.concatenate([rng.random((40, 3)), p[:2], p[-3:]])
    for asked, x, digits in ((None, p, 2), (points(spark, q), q, 12)):
        d2 = ((x[:, None] - p[None]) ** 2).sum(2)
        row, column = np.nonzero(d2 <= 0.16)
        df = points(spark, p)
        got = sorted((r.id, r.other, r.r2) for r in neighbours.radius_join(asked or df, df, 0.4, digits=digits).collect())
        assert [r[:2] for r in got] == list(zip(row.tolist(), column.tolist(), strict=True))
        assert np.allclose([r[2] for r in got], np.floor(d2[row, column] * 10.0**digits + 0.5) / 10.0**digits, rtol=0, atol=2e-12)
        assert digits > 2 or {r[2] for r in got if r[:2] == (260, 261)} == {0.13}


@pytest.mark.parametrize("room", [1 << 9, 1 << 12, 1 << 24])
def test_pairs_are_arranged_piece_by_piece(monkeypatch, room):
    """Room, or lists, for a few pieces only, and copies that fill it several times: every pair once; in order of distance where these repeat."""
    monkeypatch.setattr(neighbours, "SORTED_PAIRS", room)
    monkeypatch.setattr(neighbours, "OTHER_BITS", 10)
    rng = np.random.default_rng(29)
    for most in (20, 1 << 24):
        code = rng.integers(0, most, (700, 900)).astype(float)
        hit = rng.random(code.shape) < 0.4
        hit[:300, :500] = True
        hit[:, 850] = False
        ids, others = 7000 + np.arange(700), 9000 + np.arange(900)
        queries_of = [slice(0, 300), slice(300, 420), slice(420, 700)]
        named = [ids[a] for a in queries_of]
        pieces = [(named[i], others[o], *np.nonzero(hit[a, o]), code[a, o][hit[a, o]]) for o in (slice(0, 500), slice(500, 850), slice(850, 851), slice(851, 900)) for i, a in enumerate(queries_of)]
        made = list(neighbours._by_distance(iter(pieces), 10.0))
        got = np.stack([np.concatenate([m[c] for m in made]) for c in ("id", "other", "r2")])
        row, column = np.nonzero(hit)
        assert sorted(map(tuple, got.T.tolist())) == sorted(zip(ids[row].tolist(), others[column].tolist(), (code[row, column] / 10).tolist(), strict=True))
        down = int((np.diff(got[2]) < 0).sum())
        assert down < 0.1 * len(row) if most == 20 else down > 0.4 * len(row)


def test_files_of_pairs_within_a_radius_are_small(spark, tmp_path):
    """16 million pairs whose vectors lie apart: under 6 bytes each in Parquet, and all of them."""
    v = (np.random.default_rng(28).random((4000, 3)) * 0.05).astype(np.float32)
    emb = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 3), pa.int32()), pa.array(v.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(v))), "embedding": emb, "label": pa.array(np.zeros(len(v), np.int32))}), tmp_path / "embeddings.parquet")
    queries.radius_neighbours(spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    rows = spark.read.parquet(f"{tmp_path}/pairs")
    x = v.astype(float) + 0.5
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    assert rows.select("id", "other").distinct().count() == rows.count() == d2.size and d2.max() <= 0.01
    assert math.isclose(rows.agg(F.sum("r2")).first()[0], float(np.round(d2, 8).sum()), rel_tol=1e-9)
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 6 * d2.size, size / d2.size


def test_density_compares_copies_once(spark, monkeypatch):
    """1,000 copies of each of 30 places: as many comparisons as for the places alone, and a row for each id."""
    monkeypatch.setattr(tree, "BROADCAST_POINTS", 0)
    p = np.random.default_rng(24).random((30, 3))
    got = {r.id: r.density for r in neighbours.kernel_density(points(spark, np.tile(p, (1000, 1))), 0.4).collect()}
    one = {r.id: r.density for r in neighbours.kernel_density(points(spark, p), 0.4).collect()}
    assert len(got) == 30000 and all(math.isclose(v, 1000 * one[i % 30], rel_tol=1e-9) for i, v in got.items())


@pytest.mark.parametrize("copies", [1, 3])
def test_leaves_of_a_block_are_searched_together(monkeypatch, copies):
    """Clusters, lines, distant places: exact, and no call for each leaf. Only a leaf with too few places, or with very many in reach, is searched alone."""
    rng = np.random.default_rng(25)
    p = np.concatenate([rng.random((3000, 3)), 0.5 + 1e-3 * rng.normal(size=(900, 3)), np.stack([rng.random(600), np.zeros(600), np.zeros(600)], 1), 20 * rng.normal(size=(5, 3))])
    p, n = p[rng.permutation(len(p))], rng.integers(1, copies + 1, len(p))
    table = pa.table([pa.array(np.zeros(len(p)), pa.int32()), *map(pa.array, np.ascontiguousarray(p.T)), pa.array(n)], ["grp", *AXES, "copies"])
    alone, search = [], tree._Held.nearest
    monkeypatch.setattr(tree._Held, "nearest", lambda self, q, *a: alone.append(len(q)) or search(self, q, *a))
    for k in (6, 33):
        alone.clear()
        got = tree._search_at_home(table, None, tree.Blocks(np.zeros(len(p), np.int64), p, len(p)), k)
        q = np.stack([got[a].to_numpy() for a in AXES], 1)
        d2 = ((q[:, None] - p[None]) ** 2).sum(2)
        order = np.argsort(d2, 1)
        at = (np.cumsum(n[order], 1) >= k).argmax(1)
        assert np.allclose(got["r2"].to_numpy(), np.take_along_axis(d2, order[np.arange(len(q)), at][:, None], 1)[:, 0], rtol=1e-9, atol=1e-15)
        assert set(got["n"].to_pylist()) == {k} and not any(got["near"].to_pylist())
        assert len(alone) < len(p) / tree.LEAF_PLACES / 4, len(alone)
