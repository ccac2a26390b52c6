"""Sequences from a table bucketed by id: the same particles and pictures, without moving rows to match them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymill import __main__ as command
from skymill.config import RenderConfig
from skymill.plans import render
from skymill.sinks.bucketed import write_bucketed
from skymill.sources.bucketed import open_bucketed

SCHEMA = "id long, ptype int, x double, y double, z double, extra string"
CFG = RenderConfig(itmax=3, lbox=0.7, xc=0.1, yc=0.5, zc=0.5, width=16, height=12, mask=1)


def snapshots(spark, folder, odd):
    """Four snapshots; ids go and come. odd: also repeated ids (a third of the rows has one), equal rows and rows without an id."""
    rng = np.random.default_rng(8)
    a, paths = rng.random((300, 3)), []
    for k in range(4):
        rows = [(i, i % 2, *map(float, (a[i] + 0.03 * k) % 1), "e") for i in range(300) if i % (5 + k) != k]
        if odd:
            more = rng.random((200, 3))
            rows += [(7 if i < 150 else None, i % 2, *map(float, v), None) for i, v in enumerate(more)] + rows[:20]
        paths.append(f"{folder}/s{k}.parquet")
        spark.createDataFrame(rows, SCHEMA).write.parquet(paths[-1])
    return paths


def stored(spark, paths, folder, **more):
    write_bucketed([spark.read.parquet(p) for p in paths], f"{folder}/it's stored", 1.0, **more)
    return open_bucketed(spark, f"{folder}/it's stored")


def rows(df):
    return sorted((tuple((v is None, v or 0) for v in r) for r in df.select("id", "ptype", "frame", *[F.round(c, 9) for c in "xyz"]).collect()))


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("mode", ["hermite", "catmull", "catmull4"])
def test_same_particles_as_by_joins(spark, tmp_path, mode, odd):
    paths = snapshots(spark, tmp_path, odd)
    store = stored(spark, paths, tmp_path, buckets=4)
    assert (store.rest is not None) == odd and store.places == 4
    kept = store.named.count() + (store.rest.count() if odd else 0)
    assert kept == sum(spark.read.parquet(p).count() for p in paths)
    want = rows(render.sequence_particles(spark, CFG, paths, mode, 1.0))
    assert want and rows(render.sequence_particles(spark, CFG, store, mode, 1.0)) == want


@pytest.mark.parametrize("mode", ["hermite", "catmull4"])
def test_nothing_is_shuffled_and_read_once(spark, tmp_path, mode):
    store = stored(spark, snapshots(spark, tmp_path, False), tmp_path)
    df = render.sequence_particles(spark, CFG, store, mode, 1.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"\bExchange (\w+)", plan)
    assert not moved, plan
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and "Bucketed: true" in plan
    assert not re.search("SortMergeJoin|ShuffledHashJoin", plan)


def test_empty_and_single_snapshots(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    write_bucketed([none, none], f"{tmp_path}/none", 1.0, 3)
    store = open_bucketed(spark, f"{tmp_path}/none")
    assert store.rest is None and render.sequence_particles(spark, CFG, store, "hermite", 1.0).count() == 0
    with pytest.raises(ValueError, match="too few"):
        render.render_sequence(spark, CFG, store, "catmull")


def test_written_folder_is_not_overwritten(spark, tmp_path):
    paths = snapshots(spark, tmp_path, False)
    stored(spark, paths, tmp_path)
    with pytest.raises(Exception, match="(?i)exist|empty"):
        stored(spark, paths, tmp_path)


def test_pictures_and_command_line(spark, tmp_path):
    paths = snapshots(spark, tmp_path, False)
    snaps = spark.createDataFrame(list(enumerate(paths)), "seq int, root string")
    want = {r.frame: bytes(r.image) for r in render.render_sequence(spark, CFG, snaps, "catmull", probes=1).collect()}
    got = {r.frame: bytes(r.image) for r in render.render_sequence(spark, CFG, stored(spark, paths, tmp_path), "catmull", probes=1).collect()}
    assert got == want and sorted(got) == list(range(5))
    (tmp_path / "list.txt").write_text("\n".join(paths))
    for where, more in (("first", ["-sequence", f"{tmp_path}/list.txt"]), ("again", [])):
        command.main(["-input", paths[0], "-output", f"{tmp_path}/{where}/f", "-lbox", "1", "-all_types", "-width", "12", "-height", "10", "-itmax", "3", *more, "-bucketed", f"{tmp_path}/cli"])
    first, again = (sorted((p.name, p.read_bytes()) for p in (tmp_path / w).iterdir() if p.suffix == ".png") for w in ("first", "again"))
    assert first == again and len(first) == 7
