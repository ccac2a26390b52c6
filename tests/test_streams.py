"""Streams with state, and counters that a deposit gives as it runs."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skymill.config import RenderConfig
from skymill.operators import deposit, levels
from skymill.plans import render
from skymill.sinks import images
from skymill.sources import snapshots
from skymill.streaming import locked

SCHEMA = "ptype int, x double, y double, z double, snapshot int"


def cloud(spark, snapshot, n, seed, ptype=1):
    """n particles that crowd towards the middle, more so with a greater seed."""
    shift = F.pow(F.rand(seed), F.lit(1.0 + seed % 3)) * 0.4
    return spark.range(n).select(F.lit(ptype).alias("ptype"), (F.lit(0.5) + shift).alias("x"), (0.3 + 0.5 * F.rand(seed + 1)).alias("y"), F.rand(seed + 2).alias("z"), F.lit(snapshot).alias("snapshot"))


def settings(**more):
    return RenderConfig(lbox=1.0, width=20, height=16, mask=-1, **more)


def arrive(spark, folder, *clouds):
    for c in clouds:
        c.coalesce(1).write.partitionBy("snapshot").mode("append").parquet(folder)


def run(spark, tmp_path, **more):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    return sorted(map(tuple, locked.run_arrivals(stream, settings(**more), 1.0, str(tmp_path / "store"), str(tmp_path / "live")).collect()))


def levels_of(df):
    pixels = deposit.cic_map(df, 20, 16, (0.5, 0.5), 1.0, ("snapshot",))
    row = levels.auto_levels(pixels, keys=("snapshot",)).first()
    return row["vmin"], row["vmax"]


def picture(spark, df, low, high):
    fixed = settings(auto_levels=False, vmin=low, vmax=high)
    pixels = deposit.cic_map(df.withColumn("frame", F.lit(0)), 20, 16, (0.5, 0.5), 1.0, ("frame",))
    return images.decode_png(bytes(images.render_images(render.finish(pixels, fixed), 20, 16, render.empty_colour(spark, fixed)).first()["image"]))


def test_first_levels_hold_over_restarts(spark, tmp_path):
    """A later start goes on from the state; a late snapshot keeps its number and gets the first one's levels; nothing new changes nothing."""
    a, b, c = (cloud(spark, k, 900, 10 * k + 1) for k in (5, 7, 2))
    arrive(spark, str(tmp_path / "in"), a)
    first = run(spark, tmp_path)
    low, high = levels_of(a)
    assert [(r[0], r[1]) for r in first] == [(5, 5)] and first[0][2:] == pytest.approx((low, high))
    assert levels_of(c) != pytest.approx((low, high))
    arrive(spark, str(tmp_path / "in"), b, c)
    second = run(spark, tmp_path)
    assert [(r[0], r[1]) for r in second] == [(2, 5), (5, 5), (7, 5)] and len({r[2:] for r in second}) == 1
    for k, df in ((5, a), (7, b), (2, c)):
        drawn = images.decode_png((tmp_path / f"live.{k:04d}.png").read_bytes())
        assert (drawn == picture(spark, df, low, high)).all()
    before = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("live.*.png")}
    assert run(spark, tmp_path) == second and {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("live.*.png")} == before


def test_parts_of_a_snapshot_add_up(spark, tmp_path):
    """Of snapshots that come at once the least number is the first; what comes later for one is added, and the levels stay."""
    a, more, b = cloud(spark, 1, 700, 3), cloud(spark, 1, 500, 8), cloud(spark, 4, 600, 14)
    arrive(spark, str(tmp_path / "in"), b, a)
    got = run(spark, tmp_path)
    low, high = levels_of(a)
    assert [r[:2] for r in got] == [(1, 1), (4, 1)] and got[0][2:] == pytest.approx((low, high))
    arrive(spark, str(tmp_path / "in"), more)
    assert run(spark, tmp_path) == got
    drawn = images.decode_png((tmp_path / "live.0001.png").read_bytes())
    assert (drawn == picture(spark, a.unionByName(more), low, high)).all()


def test_state_survives_a_death_between_the_streams(spark, tmp_path):
    """Deposited, but not drawn: the next start draws it once, with the levels of what was deposited first."""
    a, b = cloud(spark, 3, 400, 2), cloud(spark, 1, 400, 5)
    arrive(spark, str(tmp_path / "in"), a)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    locked._finished(locked.deposit_arrivals(stream, settings(), 1.0, str(tmp_path / "store")))
    arrive(spark, str(tmp_path / "in"), b)
    got = run(spark, tmp_path)
    assert [r[:2] for r in got] == [(1, 3), (3, 3)] and got[0][2:] == pytest.approx(levels_of(a))


def test_nothing_in_view(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), cloud(spark, 0, 50, 1))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    none = RenderConfig(lbox=1e-6, xc=0.01, width=8, height=8, mask=-1)
    assert locked.run_arrivals(stream, none, 1.0, str(tmp_path / "other")).count() == 0


def test_counters_of_kernels(spark):
    rows = [(0.5, 0.5, 0.01), (0.5, 0.5, 0.05), (0.5, 0.5, 0.12), (0.5, 0.5, 0.3), (0.5, 0.5, 0.0), (0.5, 0.5, None), (9.0, 0.5, 0.01), (None, 0.5, 0.01), (0.5, None, 0.3)]
    df, seen = spark.createDataFrame(rows, "x double, y double, h double"), Observation()
    deposit.sph_map(df, 100, 100, (0.5, 0.5), 1.0, seen=seen)
    got = seen.get
    assert {k: got[k] for k in ("n_particles", "n_deposited", "n_outside", "n_without", "n_skipped", "n_capped")} == {"n_particles": 9, "n_deposited": 3, "n_outside": 2, "n_without": 2, "n_skipped": 2, "n_capped": 1}
    assert sorted(deposit.bands_seen(got)) == sorted(map(tuple, deposit.h_bands(df, 100, 1.0).collect()))


@pytest.mark.parametrize("compat", [False, True])
def test_counters_of_cells(spark, compat):
    rows = [(0.5, 0.5), (-0.04, 0.5), (-0.06, 0.5), (0.5, 1.04), (0.5, 1.06), (None, 0.5)]
    seen = Observation()
    pixels = deposit.cic_map(spark.createDataFrame(rows, "x double, y double"), 10, 10, (0.5, 0.5), 1.0, compat=compat, seen=seen)
    assert pixels.count() and seen.get == {"n_particles": 6, "n_deposited": 4 if compat else 3, "n_outside": 2 if compat else 3}


@pytest.mark.parametrize("more", [{}, {"lock_levels": True}, {"zoom": 2}, {"kernel_smoothing": True}, {"auto_levels": False, "vmin": 0.0, "vmax": 3.0}])
def test_renders_tell_what_they_deposited(spark, tmp_path, more):
    snapshots.register(spark)
    path = str(tmp_path / "s.parquet")
    cloud(spark, 0, 300, 4).drop("snapshot").withColumn("id", F.lit(1).cast("long")).write.parquet(path)
    got = render.render_to_files(spark, settings(input=path, output=str(tmp_path / "o"), **more))
    assert got["n_particles"] == 300 * more.get("zoom", 1)
    assert got["n_particles"] == got["n_deposited"] + got["n_outside"] + got.get("n_without", 0) + got.get("n_skipped", 0)
