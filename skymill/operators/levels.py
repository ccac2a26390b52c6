"""Levels of images, noise floor, hole filling and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

MIN_RANGE = 0.01
FILL_PASSES = 64
#: Pixels of a frame that one task may sort, and bins of a round where there are more.
ONE_TASK, BINS = 1 << 21, 4096
TILE = 512


def auto_levels(pixels: DataFrame, log_scale: bool = True, lo: float = 0.10, hi: float = 1.0, keys: tuple[str, ...] = ("frame",), most: int | None = None) -> DataFrame:
    """(keys, n, vmin, vmax): the values at two shares of the sorted positive pixels, by truncated index, at least MIN_RANGE apart.

    most: pixels of a frame at most, where that is known. Up to ONE_TASK of them are sorted in one task; others are counted
    in bins between the frame's least and greatest value, and bins that hold a value looked for are cut into finer ones,
    until the values in them are few or equal. Either way the same pixels are picked.
    """
    value = F.log10("rho") if log_scale else F.col("rho")
    values = pixels.filter("rho > 0").select(*keys, value.alias("v"))
    ranks = _ranks_sorted if most is not None and most <= ONE_TASK else _ranks_binned
    picked = ranks(values, keys, lo, hi)
    return picked.withColumn("vmax", F.when(F.col("vmax") - F.col("vmin") < MIN_RANGE, F.col("vmin") + MIN_RANGE).otherwise(F.col("vmax")))


def _places(n: Column, lo: float, hi: float) -> tuple[Column, Column]:
    """Two places in n sorted values, from 0."""
    last = n - 1
    first = F.floor(lo * last)
    second = F.least(F.floor(hi * last), last)
    return first, F.when(second <= first, F.least(first + 1, last)).otherwise(second)


def _ranks_sorted(values: DataFrame, keys: tuple[str, ...], lo: float, hi: float) -> DataFrame:
    w = Window.partitionBy(*keys)
    ranked = values.select(*keys, "v", F.row_number().over(w.orderBy("v")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    first, second = _places(F.col("n"), lo, hi)
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("i") - 1 == first, F.col("v"))).alias("vmin"), F.max(F.when(F.col("i") - 1 == second, F.col("v"))).alias("vmax"))


def _ranks_binned(values: DataFrame, keys: tuple[str, ...], lo: float, hi: float) -> DataFrame:
    """Only counts by bin are shuffled: for each frame and round at most twice BINS rows from a task."""
    values = staged(values)
    whole = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    first, second = _places(F.col("n"), lo, hi)
    which = F.array(F.struct(F.lit("vmin").alias("name"), first.cast("long").alias("place")), F.struct(F.lit("vmax").alias("name"), second.cast("long").alias("place")))
    # For each value looked for: its place among the values of the bin a..b, and how many those are. A few rows for each frame.
    todo = whole.select(*keys, "n", "a", "b", F.explode(which).alias("k")).select(*keys, F.col("n").alias("total"), "k.name", "k.place", "n", "a", "b")
    done = None
    while True:
        todo = staged(todo)
        single = todo.filter("a = b").select(*keys, "total", "name", F.col("a").alias("v"))
        done = single if done is None else done.unionByName(single)
        rest = todo.filter("a < b")
        if not rest.take(1):
            break
        inside = values.join(F.broadcast(rest), [*keys]).filter(F.col("v").between(F.col("a"), F.col("b")))
        # The greatest value falls in the last bin; equal values always share one.
        bin_of = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * BINS).cast("int"), F.lit(BINS - 1))
        counts = inside.groupBy(*keys, "total", "name", "place", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy("bin")) - F.col("n")
        hit = counts.withColumn("place", F.col("place") - before).filter((F.col("place") >= 0) & (F.col("place") < F.col("n")))
        todo = hit.select(*keys, "total", "name", "place", "n", "a", "b")
    return done.groupBy(*keys).agg(F.max("total").alias("n"), F.max(F.when(F.col("name") == "vmin", F.col("v"))).alias("vmin"), F.max(F.when(F.col("name") == "vmax", F.col("v"))).alias("vmax"))


def locked_levels(pixels: DataFrame, **options) -> DataFrame:
    """(frame, vmin, vmax) of all frames: those of the first frame, computed before any floor or filling."""
    frames = pixels.select("frame").distinct()
    levels = auto_levels(pixels.filter(F.col("frame") == 0), **options).select("vmin", "vmax")
    return frames.crossJoin(F.broadcast(levels))  # one row of levels


def noise_floor(vmin: Column, log_scale: bool = True, fraction: float = 1e-4, compat: bool = False) -> Column:
    """Densities below this count as nothing. compat: the level is an exponent on a linear scale too."""
    return F.pow(F.lit(10.0), vmin) * fraction if log_scale or compat else vmin * fraction


def apply_floor(pixels: DataFrame, floor: Column) -> DataFrame:
    return pixels.filter(F.col("rho") >= floor)


def image_report(pixels: DataFrame, n_pixels: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n_positive, max_rho, min_positive, mean_rho, n_above_floor): the floor is a millionth of the maximum."""
    top = pixels.groupBy(*keys).agg(F.count_if(F.col("rho") > 0).alias("n_positive"), F.max("rho").alias("max_rho"), F.min(F.when(F.col("rho") > 0, F.col("rho"))).alias("min_positive"), (F.sum("rho") / n_pixels).alias("mean_rho"))
    joined = pixels.join(F.broadcast(top), list(keys)) if keys else pixels.crossJoin(F.broadcast(top))
    return joined.groupBy(*keys, "n_positive", "max_rho", "min_positive", "mean_rho").agg(F.count_if(F.col("rho") > 1e-6 * F.col("max_rho")).alias("n_above_floor"))


def fill_once(pixels: DataFrame, width: int, height: int, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One pass of hole filling: each empty inner pixel gets the mean of its positive neighbours. Joins only, no Python."""
    known = pixels.filter("rho > 0")
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    spread = known.select(*keys, "iy", "ix", "rho", F.explode(around).alias("d")).select(*keys, (F.col("iy") + F.col("d.dy")).alias("iy"), (F.col("ix") + F.col("d.dx")).alias("ix"), "rho", F.lit(0).alias("own"))
    both = spread.unionByName(known.select(*keys, "iy", "ix", "rho", F.lit(1).alias("own")))
    merged = both.groupBy(*keys, "iy", "ix").agg(F.max(F.when(F.col("own") == 1, F.col("rho"))).alias("own"), F.avg(F.when(F.col("own") == 0, F.col("rho"))).alias("near"))
    inner = F.col("iy").between(1, height - 2) & F.col("ix").between(1, width - 2)
    return merged.filter(F.col("own").isNotNull() | inner).select(*keys, "iy", "ix", F.coalesce("own", "near").alias("rho"))


def fill_array(image: np.ndarray, passes: int, edge: tuple[bool, bool, bool, bool]) -> np.ndarray:
    """Fill holes of a dense image; edge: which sides (top, bottom, left, right) are the picture's own and stay as they are."""
    h, w = image.shape
    for _ in range(passes):
        wide = np.pad(image, 1)
        known = (wide > 0).astype(np.float64)
        total, count = np.zeros((h, w)), np.zeros((h, w))
        for dy in range(3):
            for dx in range(3):
                if dy != 1 or dx != 1:
                    total += np.where(wide[dy : dy + h, dx : dx + w] > 0, wide[dy : dy + h, dx : dx + w], 0)
                    count += known[dy : dy + h, dx : dx + w]
        hole = (image <= 0) & (count > 0)
        for side, on in zip((np.s_[:1], np.s_[-1:], np.s_[:, :1], np.s_[:, -1:]), edge, strict=True):
            if on:
                hole[side] = False
        if not hole.any():
            break
        image = np.where(hole, total / np.maximum(count, 1), image)
    return image


def fill_holes(pixels: DataFrame, width: int, height: int, passes: int = FILL_PASSES, tile: int = TILE) -> DataFrame:
    """(frame, iy, ix, rho): holes filled by up to so many passes.

    Images are cut into tiles with a margin as wide as the passes. A value moves one pixel in a pass, so a tile's inside
    is exact and memory does not depend on the image's size. Only positive pixels are shuffled.
    """
    margin = passes

    def near(c: str, n: int) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - margin) / tile).cast("int")), F.least(F.lit((n - 1) // tile), F.floor((F.col(c) + margin) / tile).cast("int")))

    spread = pixels.filter("rho > 0").select("frame", "iy", "ix", "rho", F.explode(near("iy", height)).alias("ty"))
    spread = spread.select("frame", "iy", "ix", "rho", "ty", F.explode(near("ix", width)).alias("tx"))

    def run(table: pa.Table) -> pa.Table:
        frame, ty, tx = (table[c][0].as_py() for c in ("frame", "ty", "tx"))
        y0, x0 = max(0, ty * tile - margin), max(0, tx * tile - margin)
        y1, x1 = min(height, (ty + 1) * tile + margin), min(width, (tx + 1) * tile + margin)
        image = np.zeros((y1 - y0, x1 - x0))
        image[table["iy"].to_numpy() - y0, table["ix"].to_numpy() - x0] = table["rho"].to_numpy()
        image = fill_array(image, passes, (y0 == 0, y1 == height, x0 == 0, x1 == width))
        own = image[ty * tile - y0 : (ty + 1) * tile - y0, tx * tile - x0 : (tx + 1) * tile - x0]
        iy, ix = np.nonzero(own > 0)
        return pa.table({"frame": pa.array(np.full(len(iy), frame), pa.int32()), "iy": pa.array(iy + ty * tile, pa.int32()), "ix": pa.array(ix + tx * tile, pa.int32()), "rho": pa.array(own[iy, ix])})

    return spread.groupBy("frame", "ty", "tx").applyInArrow(run, "frame int, iy int, ix int, rho double")


def densify(pixels: DataFrame, frames: DataFrame, width: int, height: int) -> DataFrame:
    """Every pixel of every frame, empty ones as zero."""
    grid = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("iy")).select("frame", "iy", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("ix"))
    return grid.join(pixels, ["frame", "iy", "ix"], "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))


def global_levels(levels: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """One row (vmin, vmax) for many snapshots: a low share of their lower levels and a high share of their upper ones, by truncated index."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    low = F.row_number().over(Window.orderBy("vmin"))
    high = F.row_number().over(Window.orderBy("vmax"))
    ranked = levels.select("vmin", "vmax", n.alias("n"), low.alias("lo"), high.alias("hi"))
    return ranked.agg(F.max(F.when(F.col("lo") - 1 == F.floor(lo * (F.col("n") - 1)), F.col("vmin"))).alias("vmin"), F.max(F.when(F.col("hi") - 1 == F.floor(hi * (F.col("n") - 1)), F.col("vmax"))).alias("vmax"))
