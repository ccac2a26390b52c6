"""Snapshot sources, image sinks, whole renders and the stream."""

from dataclasses import replace

import h5write
import numpy as np
import pytest
from pyspark.sql import functions as F

from skymill import __main__ as cli
from skymill.config import RenderConfig
from skymill.operators import levels, select
from skymill.plans import render
from skymill.sinks import images
from skymill.sources import files, gadget, h5file, hdf5, snapshots
from skymill.streaming import watch


@pytest.fixture
def snapshot(tmp_path):
    rng = np.random.default_rng(1)
    counts = [30, 50, 0, 0, 20]
    pos, vel = rng.random((100, 3)), rng.normal(size=(100, 3))
    ids = np.arange(100, dtype=np.uint64) + np.uint64(2**63 - 50)
    return str(tmp_path / "snap"), counts, pos, vel, ids


@pytest.mark.parametrize("fmt", [1, 2])
def test_gadget_round_trip(spark, snapshot, fmt):
    root, counts, pos, vel, ids = snapshot
    gadget.write_snapshot(root, counts, pos, vel, ids, box=50.0, redshift=1.0, fmt=fmt)
    got = snapshots.read_particles(spark, root).orderBy(F.col("id").cast("decimal(20,0)")).toPandas()
    want = np.argsort(ids.view(np.int64))
    assert len(got) == 100
    assert np.allclose(got[["x", "y", "z"]], pos[want].astype(np.float32)) and np.allclose(got[["vx", "vy", "vz"]], vel[want].astype(np.float32))
    assert got["id"].tolist() == ids.view(np.int64)[want].tolist()
    head = snapshots.read_header(spark, root).first()
    assert (head.num_types, list(head.npart), head.box_size, head.redshift, head.time) == (5, counts, 50.0, 1.0, 0.5)
    assert {r.ptype: r.n for r in snapshots.header_counts(snapshots.read_header(spark, root)).collect()} == dict(enumerate(counts))


def test_several_files_and_ranges(spark, snapshot):
    root, _, pos, _, ids = snapshot
    gadget.write_snapshot(root + ".0", [10, 30], pos[:40], None, ids[:40], num_files=2, nall=[20, 80])
    gadget.write_snapshot(root + ".1", [10, 50], pos[40:], None, ids[40:], num_files=2, nall=[20, 80])
    snapshots.register(spark)
    df = spark.read.format("skymill_gadget").option("rows", 7).load(root)
    assert df.rdd.getNumPartitions() > 10
    assert {r.ptype: r["count"] for r in df.groupBy("ptype").count().collect()} == {0: 20, 1: 80}
    assert df.filter(select.type_filter(1)).count() == 20
    assert df.filter("vx is null").count() == 100
    assert np.isclose(df.agg(F.sum("x")).first()[0], pos[:, 0].astype(np.float32).astype(float).sum())


def test_missing_snapshot():
    with pytest.raises(FileNotFoundError):
        files.snapshot_files("/nowhere/snap")


SAMPLES = {"f8": np.linspace(0, 1, 51).reshape(17, 3), "f4": np.arange(51, dtype=">f4").reshape(17, 3), "u8": np.arange(17, dtype="<u8") + 2**63, "i2": np.arange(-8, 9, dtype="<i2")}


@pytest.mark.parametrize(("new", "dense"), [(False, False), (True, False), (True, True)])
def test_h5_structures(tmp_path, new, dense):
    """Every structure that is read: groups, attributes and datasets of either style, all layouts and filters, any rows."""
    w = h5write.Writer(new, dense)
    sets, want = {}, {}
    kinds = [(None, (), "tree")] + [(c, p, "tree") for c in (4, 17, 1) for p in ((), ("deflate",), ("shuffle", "deflate"), ("shuffle", "deflate", "checksum"))]
    if new:
        kinds += [(20, (), "single"), (20, ("deflate",), "single"), (5, (), "implicit"), (3, (), "fixed"), (3, ("shuffle", "deflate"), "fixed"), (1, ("deflate",), "fixed")]
    for kind, values in SAMPLES.items():
        for chunk, packed, index in kinds:
            name = f"{kind}_{chunk}_{'+'.join(packed)}_{index}"
            shape = None if chunk is None else (chunk, *([2] if index in ("tree", "fixed", "implicit") and values.ndim == 2 else values.shape[1:]))
            missing = (1,) if chunk in (3, 4) else ()
            sets[name], want[name] = w.dataset(values, shape, packed, index, missing), values.copy()
            if missing:
                hole = [slice(chunk, 2 * chunk)] if values.ndim == 1 else [slice(0, chunk), slice(2, 3)]
                want[name][tuple(hole)] = 0
    sets["empty"], want["empty"] = w.dataset(np.zeros((0, 3), "f4")), np.zeros((0, 3), "f4")
    attrs = {f"a{i}": np.float64(i) for i in range(40)} | {"list": np.arange(6, dtype="<i4"), "text": np.array(b"some text", "S9"), "f4": np.float32([1.5])}
    inner = w.group(sets, attrs, split=True)
    w.save(tmp_path / "x.h5", w.group({"Group": inner, "Other": w.group({})}), shift=512 if new else 0)
    with h5file.H5File(str(tmp_path / "x.h5")) as f:
        assert "Group" in f and "None" not in f and "Group/none" not in f and set(f["Group"].links) == set(sets)
        got = f["Group"].attrs
        assert set(got) == set(attrs) and all((np.asarray(got[k]) == attrs[k]).all() for k in attrs)
        for name, values in want.items():
            node = f["Group/" + name]
            assert node.shape == values.shape and node.dtype == values.dtype, name
            for low, high in [(0, 17), (0, 3), (3, 4), (5, 14), (16, 99), (9, 9)]:
                assert (node.rows(low, high) == values[low:high]).all(), (name, low, high)


def test_h5_refuses_what_it_cannot_read(tmp_path):
    (tmp_path / "no.h5").write_bytes(b"nothing" * 300)
    with pytest.raises(ValueError, match="no HDF5"):
        h5file.H5File(str(tmp_path / "no.h5"))
    with pytest.raises(FileNotFoundError):
        h5file.H5File(str(tmp_path / "none.h5"))


def h5_snapshot(path, parts, new, box=2.0, files=1, total=None, compressed=True):
    """parts: for each type (positions, velocities, ids) or None."""
    w = h5write.Writer(new)
    groups = {}
    for t, part in enumerate(parts):
        if part is not None:
            pos, vel, ids = part
            packed = ("shuffle", "deflate") if compressed else ()
            sets = {"Coordinates": w.dataset(pos.astype("<f4"), (16, 3), packed), "ParticleIDs": w.dataset(ids.astype("<u8"), (16,), packed)}
            if vel is not None:
                sets["Velocities"] = w.dataset(vel.astype("<f4"))
            groups[f"PartType{t}"] = w.group(sets)
    counts = np.array([0 if p is None else len(p[0]) for p in parts], "<i4")
    head = {"NumPart_ThisFile": counts, "NumPart_Total": np.array(total if total is not None else counts, "<u4"), "NumFilesPerSnapshot": np.int32(files), "Redshift": np.float64(1.0), "BoxSize": np.float64(box), "MassTable": np.zeros(len(parts)), "Time": np.float64(0.5), "HubbleParam": np.float64(0.7), "Omega0": np.float64(0.3), "OmegaLambda": np.float64(0.7), "Scale-factor": np.float64([0.5])}
    groups["Header"] = w.group({}, head)
    groups["Parameters"] = w.group({}, {"HubbleParam": np.float64(0.68), "Omega0": np.float64(0.31), "OmegaLambda": np.float64(0.69)})
    groups["Cosmology"] = w.group({}, {"h": np.float64([0.68]), "Omega_b": np.float64([0.05]), "Omega_cdm": np.float64([0.26]), "Omega_lambda": np.float64([0.69]), "H0 [internal units]": np.float64([68.0])})
    w.save(path, w.group(groups))


@pytest.fixture(params=[False, True], ids=["old", "new"])
def h5_snap(request, tmp_path):
    rng = np.random.default_rng(5)
    parts = [(rng.random((n, 3)) * 2, rng.normal(size=(n, 3)), np.arange(n, dtype="u8") + np.uint64(1000 * t + 2**63 - 5)) if n else None for t, n in enumerate([37, 50, 0, 0, 20])]
    h5_snapshot(tmp_path / "snap.hdf5", parts, request.param)
    return str(tmp_path / "snap"), parts


def test_hdf5_snapshots(spark, h5_snap):
    root, parts = h5_snap
    head = snapshots.read_header(spark, root, True).first()
    assert (head.num_types, list(head.npart), head.box_size, head.redshift, head.time, head.omega0) == (5, [37, 50, 0, 0, 20], 2.0, 1.0, 0.5, 0.3)
    got = {(r.ptype, r.id): (r.x, r.y, r.z, r.vx, r.vy, r.vz) for r in snapshots.read_particles(spark, root, True).collect()}
    want = {(t, int(np.uint64(i).view(np.int64))): (*map(float, p), *map(float, v)) for t, part in enumerate(parts) if part for p, v, i in zip(part[0].astype("f4"), part[1].astype("f4"), part[2].astype("u8"), strict=True)}
    assert got == want
    some = snapshots.read_particles(spark, root, True, ("ptype", "x"), [0, 4])
    assert some.columns == ["ptype", "x"] and {r.ptype: r["count"] for r in some.groupBy("ptype").count().collect()} == {0: 37, 4: 20}
    df = spark.read.format("skymill_hdf5").option("rows", 7).load(root)
    assert df.rdd.getNumPartitions() == 6 + 8 + 3 and df.select("id").distinct().count() == 107
    assert hdf5.read_cosmology(root + ".hdf5", "LEGACY") == (0.5, 70.0, 0.3, 0.7, 0.7)
    assert hdf5.read_cosmology(root + ".hdf5") == (0.5, 68.0, 0.31, 0.69, 0.68)
    assert np.allclose(hdf5.read_cosmology(root + ".hdf5", "SWIFT"), (0.5, 68.0, 0.31, 0.69, 0.68))
    with pytest.raises(ValueError):
        hdf5.read_cosmology("x", "NONE")


def test_hdf5_in_several_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    for k, n in enumerate((12, 30)):
        h5_snapshot(tmp_path / f"s.{k}.hdf5", [None, (rng.random((n, 3)), None, np.arange(n) + 100 * k)], False, files=2, total=[0, 42], compressed=k == 0)
    df = snapshots.read_particles(spark, str(tmp_path / "s"), True)
    assert df.count() == 42 and df.filter("vx is null and ptype = 1").count() == 42 and df.select("id").distinct().count() == 42
    assert {r.ptype: r.n for r in snapshots.header_counts(snapshots.read_header(spark, str(tmp_path / "s"), True)).collect()} == {0: 0, 1: 42}


@pytest.mark.parametrize("more", [{}, {"kernel_smoothing": True}, {"interp_frac": 0.1}])
def test_hdf5_snapshots_are_rendered(spark, h5_snap, more):
    """The picture is that of the same particles from a Parquet file."""
    root, parts = h5_snap
    path = root + ".parquet"
    snapshots.read_particles(spark, root, True).write.parquet(path)
    cfg = RenderConfig(xc=1.0, yc=1.0, zc=1.0, lbox=2.0, width=24, height=20, mask=0b10011, isHDF5=True, **more)
    a, b = (bytes(render.render(spark, replace(cfg, input=i, extra={"box_size": 2.0})).first().image) for i in (root, path))
    assert a == b and len(np.unique(images.decode_png(a))) > 5


@pytest.mark.parametrize("method", ["grid", "leaf", "knn"])
def test_snapshots_without_ids_are_smoothed(spark, tmp_path, method):
    """The picture is that of the same particles with ids."""
    rng = np.random.default_rng(7)
    pos = rng.random((300, 3))
    gadget.write_snapshot(str(tmp_path / "none"), [300], pos)
    gadget.write_snapshot(str(tmp_path / "some"), [300], pos, None, np.arange(300, dtype=np.uint64))
    cfg = base(kernel_smoothing=True, fast_smooth=method == "grid", h_method=method if method != "grid" else "leaf", num_ngb=8)
    a, b = (images.decode_png(bytes(render.render(spark, replace(cfg, input=str(tmp_path / n))).first().image)) for n in ("none", "some"))
    assert (a == b).all() and len(np.unique(a)) > 5


def test_sources_leave_the_session_alone(spark, h5_snap):
    root, _ = h5_snap
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, None)
    snapshots.read_particles(spark, root, True).count()
    assert spark.conf.get(name, None) == before
    spark.conf.set(name, "true")
    try:
        assert snapshots.read_particles(spark, root, True).filter("ptype = 4").count() == 20
    finally:
        spark.conf.unset(name)


def test_lists_and_length_files(spark, tmp_path):
    f = tmp_path / "list.txt"
    f.write_text("# all\na\n\nb # second\n")
    assert [tuple(r) for r in snapshots.snapshot_list(spark, str(f)).orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    path = str(tmp_path / "h")
    snapshots.write_lengths(path, np.array([1.0, 2.0]), 32, 1.2)
    assert snapshots.read_lengths(path, 2, 32, 1.2).tolist() == [1, 2]
    assert snapshots.read_lengths(path, 2, 33, 1.2) is None and snapshots.read_lengths(path + "x", 2, 32, 1.2) is None


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trip(channels):
    image = np.random.default_rng(2).integers(0, 256, (7, 5, channels)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(image)) == image).all()
    with pytest.raises(ValueError):
        images.decode_png(b"nothing")
    assert images.encode_pnm(image).startswith(b"P5\n5 7\n255\n" if channels == 1 else b"P6\n5 7\n255\n")


@pytest.mark.parametrize(("kind", "channels"), [("png", "rgba"), ("png", "rgb"), ("pnm", "rgb"), ("png", "r")])
def test_images_are_drawn_by_strips(spark, monkeypatch, kind, channels):
    """Strips of three rows, some empty, the last one shorter; several frames, pixels outside."""
    monkeypatch.setattr(images, "STRIP_BYTES", 3 * 9 * len(channels))
    rng = np.random.default_rng(4)
    want = np.tile(np.array([9, 8, 7, 255], np.uint8), (2, 20, 9, 1))
    rows = []
    for frame, iy, ix in {(int(rng.integers(2)), int(rng.choice([0, 1, 2, 7, 8, 19])), int(rng.integers(9))) for _ in range(60)}:
        want[frame, iy, ix] = rng.integers(0, 256, 4)
        rows.append((frame, iy, ix, *map(int, want[frame, iy, ix])))
    rows += [(0, -1, 3, 1, 1, 1, 1), (1, 3, 9, 1, 1, 1, 1), (0, 20, 0, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "frame int, iy int, ix int, r int, g int, b int, a int")
    got = {r.frame: bytes(r.image) for r in images.render_images(df, 9, 20, (9, 8, 7, 255), kind, channels).collect()}
    for frame in (0, 1):
        image = want[frame][:, :, ["rgba".index(c) for c in channels]]
        assert got[frame] == images.encode_png(image) if kind == "png" else images.encode_pnm(image)
        if kind == "png":
            assert (images.decode_png(got[frame]) == image).all()


def test_gray_images(spark):
    """The plain gray picture: densities between two values, others at the ends; empty pixels black."""
    df = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 0.25), (0, 1, 0, 0.5), (0, 1, 1, 7.0), (0, 2, 0, -1.0), (0, 2, 1, 1.0)], "frame int, iy int, ix int, rho double")
    got = {(r.iy, r.ix): (r.r, r.g, r.b, r.a) for r in render.gray_pixels(df).collect()}
    assert got == {(0, 0): (0, 0, 0, 255), (0, 1): (64, 64, 64, 255), (1, 0): (128, 128, 128, 255), (1, 1): (255, 255, 255, 255), (2, 0): (0, 0, 0, 255), (2, 1): (255, 255, 255, 255)}
    assert {r.r for r in render.gray_pixels(df, 1.0, 7.0).filter("iy = 2 and ix = 1").collect()} == {0}
    image = images.decode_png(bytes(images.render_images(render.gray_pixels(df), 2, 3, channels="r").first().image))
    assert image[:, :, 0].tolist() == [[0, 64], [128, 255], [0, 255]]


@pytest.fixture
def parquet_snapshots(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.random((400, 3))
    out = []
    for k in range(4):
        p = (a + 0.02 * k) % 1
        path = str(tmp_path / f"s{k}.parquet")
        spark.createDataFrame([(i, i % 2, *map(float, v), 0.1, 0.0, 0.0) for i, v in enumerate(p)], "id long, ptype int, x double, y double, z double, vx double, vy double, vz double").write.parquet(path)
        out.append(path)
    return out


def base(**more):
    return RenderConfig(lbox=1.0, width=24, height=20, mask=-1, **more)


@pytest.mark.parametrize("more", [{}, {"kernel_smoothing": True}, {"kernel_smoothing": True, "fast_smooth": True}, {"kernel_smoothing": True, "h_method": "knn", "num_ngb": 8}, {"zoom": 2, "lock_levels": True}, {"itmax": 2, "rot_dangle": 30.0}])
def test_single_snapshot_renders(spark, parquet_snapshots, more):
    got = render.render(spark, base(input=parquet_snapshots[0], output="o", **more)).orderBy("frame").collect()
    assert len(got) == max(more.get("zoom", 1), more.get("itmax", 1)) and got[0].file == "o.0000.png"
    assert images.decode_png(bytes(got[0].image)).shape == (20, 24, 4)


@pytest.mark.parametrize("extra", [{}, {"snap_prev": 0}, {"snap_prev": 0, "snap_next": 3}])
def test_interpolated_renders(spark, parquet_snapshots, extra):
    named = {k: parquet_snapshots[v] for k, v in extra.items()}
    got = render.render(spark, base(snap_a=parquet_snapshots[1], snap_b=parquet_snapshots[2], itmax=3, **named)).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 1, 2] and len({bytes(r.image) for r in got}) == 3


def test_render_does_not_depend_on_partitions(spark, parquet_snapshots):
    def read(s, root, hdf5=False, columns=(), types=None):
        return snapshots.read_particles(s, root, hdf5, columns, types).repartition(n)

    seen = set()
    for n in (1, 5):
        df, cfg, _ = render.load(spark, base(input=parquet_snapshots[0]), read)
        seen.add(tuple(map(tuple, render.finish(render.density(df, cfg), cfg).select("iy", "ix", "r", "g", "b", "a").orderBy("iy", "ix").collect())))
    assert len(seen) == 1


def test_sequence(spark, parquet_snapshots):
    snaps = spark.createDataFrame(list(enumerate(parquet_snapshots)), "seq int, root string")
    got = render.render_sequence(spark, base(itmax=3), snaps, "hermite").orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(7))


@pytest.mark.parametrize(("mode", "more"), [("hermite", {}), ("catmull", {"kernel_smoothing": True, "h_method": "knn", "num_ngb": 8}), ("catmull4", {"rot_dangle": 20.0})])
def test_sequence_equals_its_intervals(spark, parquet_snapshots, mode, more):
    """One plan for all intervals gives the pictures of one render for each."""
    cfg = base(itmax=3, **more)
    snaps = spark.createDataFrame(list(enumerate(parquet_snapshots)), "seq int, root string")
    got = {r.frame: bytes(r.image) for r in render.render_sequence(spark, cfg, snaps, mode, lock=False).collect()}
    lead, behind = int(mode != "hermite"), int(mode == "catmull4")
    count = len(parquet_snapshots) - 1 - lead - behind
    assert len(got) == 2 * count + 1
    for i in range(count):
        a = i + lead
        names = {"snap_a": a, "snap_b": a + 1} | ({"snap_prev": a - 1} if lead else {}) | ({"snap_next": a + 2} if behind else {})
        alone = {r.frame: bytes(r.image) for r in render.render(spark, replace(cfg, **{k: parquet_snapshots[v] for k, v in names.items()})).collect()}
        for frame in range(3 if i == count - 1 else 2):
            assert (images.decode_png(got[2 * i + frame]) == images.decode_png(alone[frame])).all()


@pytest.mark.parametrize("probes", [1, 2])
def test_levels_of_a_probe_hold_for_a_sequence(spark, parquet_snapshots, probes):
    """The pictures are those of fixed levels, which come from the probed frames alone."""
    cfg = base(itmax=5)
    snaps = spark.createDataFrame(list(enumerate(parquet_snapshots)), "seq int, root string")
    every = render.density(render.sequence_particles(spark, cfg, parquet_snapshots, "hermite", 1.0), replace(cfg, snap_a="a", snap_b="b"))
    at = [0, 2][:probes]
    some = every.filter((F.col("frame") < 4 * (len(parquet_snapshots) - 1)) & (F.col("frame") % 4).isin(at))
    own = levels.auto_levels(some, cfg.log_scale, cfg.auto_pct_lo, cfg.auto_pct_hi).collect()
    assert len(own) == probes * (len(parquet_snapshots) - 1)
    found = render.probed_levels(spark, cfg, parquet_snapshots, "hermite", 1.0, probes=probes).first()
    low, high = sorted(r.vmin for r in own), sorted(r.vmax for r in own)
    assert found.vmin == pytest.approx(low[int(0.05 * (len(low) - 1))]) and found.vmax == pytest.approx(high[int(0.95 * (len(high) - 1))])
    got = {r.frame: bytes(r.image) for r in render.render_sequence(spark, cfg, snaps, "hermite", probes=probes).collect()}
    fixed = replace(cfg, auto_levels=False, vmin=found.vmin, vmax=found.vmax)
    want = {r.frame: bytes(r.image) for r in render.render_sequence(spark, fixed, snaps, "hermite", lock=False).collect()}
    assert got == want and len(got) == 4 * (len(parquet_snapshots) - 1) + 1


def test_lengths_are_joined_to_one_frame(spark, parquet_snapshots):
    """Particles of all frames are not shuffled by id: the cross join with frames lies above that join."""
    df, cfg, _ = render.load(spark, base(input=parquet_snapshots[0], kernel_smoothing=True, h_method="knn", num_ngb=8, rot_dangle=30.0, itmax=4))
    plan = render.with_lengths(df, cfg)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {kind: min(len(line) - len(line.lstrip(" :+-|")) for line in plan if f"Join {kind}" in line) for kind in ("Cross", "Inner")}
    assert depth["Cross"] < depth["Inner"]
    assert render.with_lengths(df, cfg).count() == df.count()


def test_files_and_command_line(spark, parquet_snapshots, tmp_path):
    out = str(tmp_path / "img" / "f")
    cli.main(["-input", parquet_snapshots[0], "-output", out, "-lbox", "1", "-all_types", "-width", "12", "-height", "10"])
    data = (tmp_path / "img" / "f.0000.png").read_bytes()
    assert images.decode_png(data).shape == (10, 12, 4)
    with pytest.raises(ValueError, match="no particle"):
        render.render_to_files(spark, base(input=parquet_snapshots[0], xc=0.5).__class__(lbox=1e-9, mask=-1, input=parquet_snapshots[0], xc=0.123, width=4, height=4))


def test_arrivals_are_rendered_once(spark, parquet_snapshots, tmp_path):
    incoming = tmp_path / "in"
    snapshots.register(spark)
    spark.read.parquet(parquet_snapshots[0]).coalesce(1).write.parquet(str(incoming))
    part = next(incoming.glob("part-*.parquet"))
    part.rename(incoming / "snap_0007.parquet")
    for f in incoming.glob(".*"):
        f.unlink()
    schema = spark.read.parquet(parquet_snapshots[0]).schema
    out = str(tmp_path / "live")
    query = watch.render_arrivals(watch.arriving(spark, str(incoming), schema), base(auto_levels=False, vmin=1.0, vmax=4.0), 1.0, out, str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert images.decode_png((tmp_path / "live.0007.png").read_bytes()).shape == (20, 24, 4)


def test_running_density(spark, parquet_snapshots, tmp_path):
    schema = spark.read.parquet(parquet_snapshots[0]).schema
    stream = spark.readStream.schema(schema).parquet(parquet_snapshots[0])
    q = watch.running_density(stream, base()).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("running").agg(F.sum("n")).first()[0] == 400
