"""Whole renders as one lazy plan: snapshots, selection, smoothing, frames, deposit, levels, filling, colour, images."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import RenderConfig, types_of
from ..functions.colour import byte, colour_pixels
from ..operators import deposit, frames, interpolate, levels, select, smoothing
from ..schema import AXES
from ..sinks.bucketed import write_bucketed
from ..sinks.images import name_frames, render_images
from ..sources.bucketed import Bucketed
from ..sources.snapshots import box_size, header_counts, read_header, read_particles
from ..staging import staged


def load(spark: SparkSession, cfg: RenderConfig, read=read_particles) -> tuple[DataFrame, RenderConfig, float]:
    """(particles with frame columns, settings in snapshot units, box length).

    In interpolating modes the snapshots are matched once and every frame's positions are computed from that; the same
    box is then selected in each frame.
    """
    cfg, box = in_snapshot_units(spark, cfg, cfg.snap_a if cfg.mode != "single" else cfg.input)
    return particles_in_frames(spark, cfg, box, lambda name: read(spark, getattr(cfg, name), cfg.isHDF5, wanted_columns(cfg), types_of(cfg.mask) if name in ("input", "snap_a") else None)), cfg, box


def wanted_columns(cfg: RenderConfig) -> tuple[str, ...]:
    """Velocities only where they move particles, ids only where particles are matched."""
    ids = ("id",) if cfg.mode != "single" else ()
    return (*ids, "ptype", *AXES, *([f"v{a}" for a in AXES] if cfg.mode == "single" and cfg.interp_frac else []))


def in_snapshot_units(spark: SparkSession, cfg: RenderConfig, root: str) -> tuple[RenderConfig, float]:
    """(settings in a snapshot's units, its box length); warns of asked types that it does not hold."""
    if root.endswith(".parquet"):
        box = float(cfg.extra.get("box_size", 1.0))
    else:
        headers = read_header(spark, root, cfg.isHDF5)
        box = box_size(headers)
        present = {r["ptype"] for r in header_counts(headers).filter("n > 0").collect()}  # a row for each type
        if absent := [t for t in types_of(cfg.mask) or [] if t not in present]:
            warnings.warn(f"the snapshot has no particles of type {absent}", stacklevel=2)
    return cfg.in_box_units(box).validated(), box


def particles_in_frames(spark: SparkSession, cfg: RenderConfig, box: float, open_snapshot) -> DataFrame:
    """Selected particles of every frame: x, y, z (turned into the frame's view), ptype, frame and lbox. open_snapshot: name -> table."""
    table = frames.frames_table(spark, cfg)
    centre = (cfg.xc, cfg.yc, cfg.zc)
    if cfg.mode == "single":
        df = interpolate.extrapolate(open_snapshot("input"), cfg.interp_frac, cfg.snap_dt)
        df = select.select_view(df, cfg.mask, centre, cfg.lbox, box)
        if cfg.kernel_smoothing:
            # Lengths are joined back by these numbers, as snapshots may have no ids; written once, so that each keeps its own.
            df = staged(df.withColumn("id", F.monotonically_increasing_id()))
        df = frames.with_frames(df, table)
    else:
        a = open_snapshot("snap_a").filter(select.type_filter(cfg.mask))
        names = {"b": "snap_b"} | ({"p": "snap_prev"} if cfg.mode == "catmull" else {}) | ({"n": "snap_next"} if cfg.mode == "catmull" and cfg.snap_next else {})
        matched = frames.with_frames(interpolate.match_by_id(a, **{k: open_snapshot(v) for k, v in names.items()}), table)
        t = F.col("t")
        df = interpolate.hermite(matched, t, box) if cfg.mode == "hermite" else interpolate.catmull_rom(matched, t, box, "n" in names)
        df = df.filter(select.cube_filter(centre, cfg.lbox, box))
    if not cfg.compat:
        df = select.unwrap_to_view(df, centre, box)
    return df


def density(df: DataFrame, cfg: RenderConfig, seen: Observation | None = None) -> DataFrame:
    """(frame, iy, ix, rho) of all frames. seen: gets the deposit's counters, over all frames, from the pass that deposits."""
    centre = (cfg.xc, cfg.yc, cfg.zc)
    if cfg.kernel_smoothing:
        df = with_lengths(df, cfg)
    if cfg.rot_dangle:
        df = frames.rotate(df, centre, cfg.rot_axis)
    if cfg.kernel_smoothing:
        return deposit.sph_map(df, cfg.width, cfg.height, centre[:2], F.col("lbox"), ("frame",), cfg.max_h_deposit_px, cfg.max_h_skip_px, seen=seen)
    return deposit.cic_map(df, cfg.width, cfg.height, centre[:2], F.col("lbox"), ("frame",), cfg.compat, seen)


def with_lengths(df: DataFrame, cfg: RenderConfig) -> DataFrame:
    """df and h. Without interpolation all frames share the lengths of the first; else each frame has its own, all in one plan."""
    method = "grid" if cfg.fast_smooth else cfg.h_method
    options = {"max_voxels": cfg.max_h_voxels} | ({"n": cfg.smooth_grid, "min_frac": cfg.min_rho_frac} if method == "grid" else {})
    if cfg.mode == "single" or cfg.frames == 1:
        first = df.filter("frame = 0").select("id", "x", "y", "z")
        if cfg.sph_cache:
            h = smoothing.cached_lengths(first, cfg.sph_cache, method, cfg.lbox, cfg.width, num_ngb=cfg.num_ngb, eta=cfg.sph_eta, **options)
        else:
            h = smoothing.smoothing_lengths(first, method, cfg.lbox, cfg.width, cfg.num_ngb, cfg.sph_eta, **options)
        if cfg.mode != "single":
            return df.join(h.select("id", "h"), "id")
        # All frames show the same particles, so lengths are joined to one frame's, not to those of all.
        table = frames.frames_table(df.sparkSession, cfg)
        return frames.with_frames(df.filter("frame = 0").drop(*table.columns).join(h.select("id", "h"), "id"), table)
    return smoothing.smoothing_lengths(df, method, cfg.lbox, cfg.width, cfg.num_ngb, cfg.sph_eta, group="frame", **options)


def finish(pixels: DataFrame, cfg: RenderConfig) -> DataFrame:
    """(frame, iy, ix, rho, r, g, b, a): levels, noise floor, filled holes and colours."""
    options = {"log_scale": cfg.log_scale, "lo": cfg.auto_pct_lo, "hi": cfg.auto_pct_hi, "most": cfg.width * cfg.height}
    locked = cfg.auto_levels and cfg.lock_levels
    if locked:
        # Written once, as the levels and the pictures both read it. One row of levels for each frame.
        pixels = staged(pixels)
        leveled = pixels.join(F.broadcast(levels.locked_levels(pixels, **options)), "frame")
    else:
        leveled = pixels.withColumns({"vmin": F.lit(float(cfg.vmin)), "vmax": F.lit(float(cfg.vmax))})
    clean = levels.apply_floor(leveled, levels.noise_floor(F.col("vmin"), cfg.log_scale, cfg.noise_floor_fraction, cfg.compat)).select("frame", "iy", "ix", "rho")
    shown = levels.fill_holes(clean, cfg.width, cfg.height, cfg.max_fill_passes)
    if locked:
        shown = shown.join(F.broadcast(leveled.select("frame", "vmin", "vmax").distinct()), "frame")
    elif cfg.auto_levels:
        shown = staged(shown)
        shown = shown.join(F.broadcast(levels.auto_levels(shown, **options).select("frame", "vmin", "vmax")), "frame")
    else:
        shown = shown.withColumns({"vmin": F.lit(float(cfg.vmin)), "vmax": F.lit(float(cfg.vmax))})
    return colour_pixels(shown, cfg, F.col("vmin"), F.col("vmax")).drop("vmin", "vmax")


def empty_colour(spark: SparkSession, cfg: RenderConfig) -> tuple[int, int, int, int]:
    """The bytes of a pixel without density: the palette's low end over the background."""
    low = spark.range(1).select(F.lit(0.0).alias("rho"))
    row = colour_pixels(low, cfg, F.lit(0.0), F.lit(1.0)).first()
    return row["r"], row["g"], row["b"], row["a"]


def render(spark: SparkSession, cfg: RenderConfig, seen: Observation | None = None) -> DataFrame:
    """(frame, image, file) of every frame of a render. seen: see density; filled by the time the first image is there."""
    df, cfg, _ = load(spark, cfg)
    images = render_images(finish(density(df, cfg, seen), cfg), cfg.width, cfg.height, empty_colour(spark, cfg))
    return name_frames(images, cfg.output or "frame")


def render_to_files(spark: SparkSession, cfg: RenderConfig) -> dict[str, int]:
    """Render and write every frame's file; returns the deposit's counters. ValueError if no particle is selected."""
    seen = Observation()
    images = render(spark, cfg, seen)
    if not images.take(1):
        raise ValueError("no particle is selected")
    images.select("file", "image").write.format("skymill_images").mode("append").save()
    return seen.get


#: The snapshots of an interval in order: its ends a and b, the one before and the one behind.
ROLES = {"hermite": ("a", "b"), "catmull": ("p", "a", "b"), "catmull4": ("p", "a", "b", "n")}


def sequence_frames(spark: SparkSession, cfg: RenderConfig, intervals: int) -> DataFrame:
    """(interval, frame, t, angle_deg, lbox): frames numbered through; an interval's last frame is the next one's first, and kept at the end only."""
    moving = replace(cfg, snap_a="a", snap_b="b")
    table = frames.frames_table(spark, moving)
    local = spark.range(intervals).select(F.col("id").cast("int").alias("interval")).crossJoin(F.broadcast(table))  # a row for each image
    kept = local.filter((F.col("frame") < cfg.itmax - 1) | (F.col("interval") == intervals - 1))
    return kept.withColumn("frame", (F.col("frame") + F.col("interval") * (cfg.itmax - 1)).cast("int"))


def stored_matches(store: Bucketed, names: tuple[str, ...], mask: int) -> DataFrame:
    """As the match of a sequence's snapshots by id, from a table that is bucketed by id: no row moves but repeated ids and rows without one."""
    start, count = names.index("a"), store.places - len(names) + 1
    interval = F.col("place") - start
    shown = interval.between(0, count - 1) & select.type_filter(mask)
    steps = {n: k - start for k, n in enumerate(names) if n != "a"}
    matched = interpolate.match_in_order(store.named, **steps).filter(shown).withColumn("interval", interval).drop("place")
    if store.rest is None:
        return matched
    others = {n: store.named.withColumn("interval", F.col("place") - names.index(n)).drop("place") for n in steps}
    rest = store.rest.filter(shown).withColumn("interval", interval).drop("place")
    return matched.unionByName(interpolate.match_by_id(rest, ("id", "interval"), **others))


def sequence_particles(spark: SparkSession, cfg: RenderConfig, roots: list[str] | Bucketed, mode: str, box: float, read=read_particles, only: list[int] | None = None) -> DataFrame:
    """Selected particles of every frame of a sequence, as particles_in_frames: the interval is a column, so all intervals are one match and one job.

    roots: names of snapshots, or all of them in one table bucketed by id, which then is read once and not shuffled.
    only: places of frames in their interval; the others are left out.
    """
    names = ROLES[mode]
    if isinstance(roots, Bucketed):
        count = roots.places - len(names) + 1
        found = stored_matches(roots, names, cfg.mask)
    else:
        count = len(roots) - len(names) + 1
        found = _read_matches(spark, cfg, roots, names, read)
    table = sequence_frames(spark, cfg, count)
    if only is not None:
        table = table.filter((F.col("frame") - F.col("interval") * (cfg.itmax - 1)).isin(only))
    matched = found.join(F.broadcast(table), "interval")
    t, centre = F.col("t"), (cfg.xc, cfg.yc, cfg.zc)
    df = interpolate.hermite(matched, t, box) if mode == "hermite" else interpolate.catmull_rom(matched, t, box, "n" in names)
    df = df.filter(select.cube_filter(centre, cfg.lbox, box))
    return df if cfg.compat else select.unwrap_to_view(df, centre, box)


def _read_matches(spark: SparkSession, cfg: RenderConfig, roots: list[str], names: tuple[str, ...], read) -> DataFrame:
    """Each interval's particles with their positions in its other snapshots."""
    parts = [read(spark, root, cfg.isHDF5, ("id", "ptype", *AXES)).select("id", "ptype", *AXES, F.lit(i).alias("place")) for i, root in enumerate(roots)]
    every = reduce(DataFrame.unionByName, parts)
    count = len(roots) - len(names) + 1
    role = {n: every.withColumn("interval", F.col("place") - k).filter(F.col("interval").between(0, count - 1)).drop("place") for k, n in enumerate(names)}
    a = role.pop("a").filter(select.type_filter(cfg.mask))
    return interpolate.match_by_id(a, ("id", "interval"), **role)


def probed_levels(spark: SparkSession, cfg: RenderConfig, roots: list[str] | Bucketed, mode: str, box: float, read=read_particles, probes: int = 1) -> DataFrame:
    """(vmin, vmax) that hold for a whole sequence, from a pass over a few frames of each interval alone (levels.global_levels of their levels).

    Each interval is looked at in `probes` frames spread over it, from its first one on. One row; null where no particle is seen.
    """
    moving = replace(cfg, snap_a="a", snap_b="b")
    step = max(1, (cfg.itmax - 1) // probes)
    at = [k for k in range(0, max(1, cfg.itmax - 1), step)][:probes]
    seen = sequence_particles(spark, cfg, roots, mode, box, read, at)
    options = {"log_scale": cfg.log_scale, "lo": cfg.auto_pct_lo, "hi": cfg.auto_pct_hi, "most": cfg.width * cfg.height}
    return levels.global_levels(levels.auto_levels(density(seen, moving), **options))


def render_sequence(spark: SparkSession, cfg: RenderConfig, snaps: DataFrame | Bucketed, mode: str = "hermite", lock: bool = True, read=read_particles, probes: int = 0) -> DataFrame:
    """(frame, image, file) of all intervals, numbered through; lock: levels of the very first frame hold for all.

    snaps: (seq, root), or the snapshots themselves in a table bucketed by id (sources.bucketed).
    probes: if not 0, levels come from that many frames of each interval before anything is drawn (probed_levels), and hold for all.
    """
    stored = isinstance(snaps, Bucketed)
    roots = snaps if stored else [r["root"] for r in snaps.orderBy("seq").collect()]  # a row for each snapshot
    if (snaps.places if stored else len(roots)) < len(ROLES[mode]):
        raise ValueError("the list has too few snapshots for this mode")
    if stored:
        cfg, box = cfg.in_box_units(snaps.box).validated(), snaps.box
    else:
        cfg, box = in_snapshot_units(spark, cfg, roots[ROLES[mode].index("a")])
    moving = replace(cfg, snap_a="a", snap_b="b", lock_levels=lock or cfg.lock_levels)
    if probes:
        found = probed_levels(spark, cfg, roots, mode, box, read, probes).first()  # one row
        if found and found["vmin"] is not None:
            moving = replace(moving, auto_levels=False, vmin=found["vmin"], vmax=found["vmax"])
    pixels = density(sequence_particles(spark, cfg, roots, mode, box, read), moving)
    images = render_images(finish(pixels, moving), cfg.width, cfg.height, empty_colour(spark, cfg))
    return name_frames(images, cfg.output or "frame")


def bucket_sequence(spark: SparkSession, cfg: RenderConfig, snaps: DataFrame, path: str, read=read_particles, buckets: int | None = None) -> None:
    """Write a list of snapshots (seq, root) as one table bucketed by id, for sequences that are rendered more than once."""
    roots = [r["root"] for r in snaps.orderBy("seq").collect()]  # a row for each snapshot
    if not roots:
        raise ValueError("the list has no snapshots")
    box = in_snapshot_units(spark, cfg, roots[0])[1]
    write_bucketed([read(spark, root, cfg.isHDF5, ("id", "ptype", *AXES)) for root in roots], path, box, buckets)


def gray_pixels(pixels: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(frame, iy, ix, r, g, b, a): plain gray between two densities."""
    v = byte((F.col("rho") - low) / (high - low))
    return pixels.select("frame", "iy", "ix", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))
