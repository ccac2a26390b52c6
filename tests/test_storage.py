"""Storage along a curve: its numbers, what views skip, and views that equal brute force wherever they lie."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skymill.functions import curves
from skymill.operators import select
from skymill.schema import AXES
from skymill.sinks.clustered import write_clustered

XYZ = "id long, ptype int, x double, y double, z double"


def walk(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from walk(children.apply(i))


def scanned(df):
    """Rows of the row groups that a plan without a shuffle reads."""
    df.collect()
    for node in walk(df._jdf.queryExecution().executedPlan()):
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()


def interleaved(cells):
    return sum((c >> b & 1) << (3 * b + k) for k, c in enumerate(cells) for b in range(curves.BITS))


def test_morton_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, p)) for p in rng.random((200, 3))] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (-3.0, 0.5, 7.0), (0.5, 0.5, None), (float("nan"), 0.5, 0.5)]
    got = spark.createDataFrame(rows, "x double, y double, z double").select("*", curves.morton(tuple(F.col(a) for a in AXES)).alias("m")).collect()
    top = (1 << curves.BITS) - 1
    for r in got:
        if r.z is None:
            assert r.m is None
        elif r.x == r.x:
            assert r.m == interleaved([min(top, max(0, int(np.floor(v * 2.0**curves.BITS)))) for v in r[:3]])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Points everywhere, as many in a clump across the box's edge and some at one place, in many small row groups."""
    folder = tmp_path_factory.mktemp("stored")
    wide = spark.range(100_000).select("id", *[F.rand(k).alias(a) for k, a in enumerate(AXES)])
    clump = spark.range(100_000, 200_000).select("id", *[F.expr(f"pmod({c} + 0.02 * randn({k}), 1)").alias(a) for k, (a, c) in enumerate(zip(AXES, (0.01, 0.5, 0.99), strict=True))])
    one = spark.range(200_000, 201_000).select("id", *[F.lit(0.25).alias(a) for a in AXES])
    wide.unionByName(clump).unionByName(one).selectExpr("id", "cast(id % 3 as int) as ptype", *AXES).write.parquet(str(folder / "plain"))
    df = spark.read.parquet(str(folder / "plain"))
    write_clustered(df, str(folder / "p"), 1.0, files=6, group_bytes=1 << 14)
    return df, spark.read.schema(df.schema).parquet(str(folder / "p"))


@pytest.mark.parametrize(("centre", "lbox"), [((0.5, 0.5, 0.5), 0.1), ((0.02, 0.5, 0.98), 0.1), ((0.0, 0.0, 0.0), 0.2), ((0.99, 0.01, 0.5), 0.15)])
def test_views_skip_row_groups(stored, centre, lbox):
    plain, df = stored
    view = select.select_view(df, -1, centre, lbox, 1.0)
    apart = " AND ".join(f"abs(pmod({a} - {c} + 0.5, 1) - 0.5) < {lbox / 2}" for a, c in zip(AXES, centre, strict=True))
    want = sorted(r.id for r in plain.filter(apart).collect())
    assert sorted(r.id for r in view.collect()) == want
    # Far less than the table, or little more than the view's own rows.
    assert scanned(view) < max(40_000, 1.5 * len(want))


def test_a_type_and_view_of_files(stored):
    plain, df = stored
    view = select.select_view(df, 0b010, (0.5, 0.2, 0.7), 0.1, 1.0)
    assert {r.id % 3 for r in view.collect()} == {1} and scanned(view) < 10_000
    assert scanned(select.select_view(plain, 0b010, (0.5, 0.2, 0.7), 0.1, 1.0)) > 60_000


def test_one_place_is_dealt_out(spark, tmp_path):
    """Very many rows of one position are cut into several files."""
    df = spark.range(20_000).select("id", F.lit(0).alias("ptype"), *[F.lit(0.5).alias(a) for a in AXES])
    write_clustered(df, str(tmp_path / "p"), 1.0, files=4)
    assert len(list((tmp_path / "p").glob("*/*.parquet"))) == 4
    assert spark.read.parquet(str(tmp_path / "p")).count() == 20_000


def test_all_rows_and_columns_are_kept(spark, tmp_path):
    odd = [(1, 0, 0.5, 0.5, 0.5), (1, 0, 0.5, 0.5, 0.5), (2, None, None, 0.5, 0.5), (3, 1, float("nan"), 0.5, 2.0)]
    df = spark.createDataFrame(odd, XYZ).withColumns({"__curve": F.lit("a"), "__curve_tie": F.lit(3)})
    write_clustered(df, str(tmp_path / "p"), 1.0)
    got = spark.read.schema(df.schema).parquet(str(tmp_path / "p")).select(*df.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    write_clustered(df.limit(0), str(tmp_path / "none"), 1.0)


@settings(max_examples=60, deadline=None)
@given(st.floats(-0.2, 1.2), st.floats(0.01, 1.6), st.floats(0.5, 3.0))
def test_plain_bounds_lose_nothing(spark, c, share, box):
    """The same rows as by the exact test alone, at the edges of the cube and beyond the box."""
    c, lbox = c * box, share * box
    xs = [c + s * lbox / 2 + k * box + e for s in (-1, 1) for k in (-1, 0, 1) for e in (-1e-12, 0, 1e-12)] + [c, 0.0, box, box / 2]
    df = spark.createDataFrame([(i, 0, float(x), c, c) for i, x in enumerate(xs)], XYZ).coalesce(1)

    def exact(d):
        d = d - box if d > box / 2 else d + box if d < -box / 2 else d
        return abs(2 * d / lbox) < 1

    assert [r.id for r in df.filter(select.cube_filter((c, c, c), lbox, box)).collect()] == [i for i, x in enumerate(xs) if exact(x - c)]
