"""Particles to density images: cloud-in-cell and kernel deposits as aggregations by pixel.

The four cloud-in-cell weights of a particle are products of its two offsets, so particles are first summed by cell
(count, sums of offsets and of their product): one row per particle goes into a partial aggregation, and only cells,
never particles, are expanded to four pixels. Depth integrates to one and is not expanded at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.kernels import projected_array, spline_3d
from ..staging import staged


def to_pixel(p: Column, centre: float, lbox: Column | float, n: int) -> Column:
    """A coordinate in pixels; the centre falls on n/2."""
    return (p - centre) * n / lbox + n / 2


def _moments(df: DataFrame, keys: tuple[str, ...], axes: dict[str, Column], within: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Cells and their moments: for each subset of axes the sum of the product of the offsets in them.

    within: first and last pixel of the image on each axis; particles that reach no pixel go before they are summed and shuffled.
    """
    cells = df.select(*keys, *[F.floor(p - 0.5).cast("int").alias(f"c_{a}") for a, p in axes.items()], *[p.alias(f"p_{a}") for a, p in axes.items()])
    for a, (first, last) in within.items():
        cells = cells.filter((F.col(f"c_{a}") >= first - 1) & (F.lit(True) if last is None else F.col(f"c_{a}") <= last))
    cells = cells.select(*keys, *[f"c_{a}" for a in axes], *[(F.col(f"p_{a}") - (F.col(f"c_{a}") + 0.5)).alias(f"t_{a}") for a in axes])
    sums = []
    for used in product((0, 1), repeat=len(axes)):
        term = F.lit(1.0)
        for a, u in zip(axes, used, strict=True):
            term = term * F.col(f"t_{a}") if u else term
        sums.append(F.sum(term).alias("m" + "".join(map(str, used))))
    return cells.groupBy(*keys, *[f"c_{a}" for a in axes]).agg(*sums)


def _corners(moments: DataFrame, keys: tuple[str, ...], axes: list[str]) -> DataFrame:
    """(keys, axes, w): each cell's weight on its corners."""
    corners = []
    for corner in product((0, 1), repeat=len(axes)):
        # (1 - t) at the low side, t at the high side, multiplied out over the moments.
        w = F.lit(0.0)
        for used in product((0, 1), repeat=len(axes)):
            if all(u or not c for u, c in zip(used, corner, strict=True)):
                sign = (-1) ** sum(u and not c for u, c in zip(used, corner, strict=True))
                w = w + sign * F.col("m" + "".join(map(str, used)))
        corners.append(F.struct(*[(F.col(f"c_{a}") + c).alias(a) for a, c in zip(axes, corner, strict=True)], w.alias("w")))
    return moments.select(*keys, F.explode(F.array(*corners)).alias("k")).select(*keys, "k.*")


def cic_map(df: DataFrame, width: int, height: int, centre: tuple[float, float], lbox: Column | float, keys: tuple[str, ...] = (), compat: bool = False, seen: Observation | None = None) -> DataFrame:
    """(keys, iy, ix, rho): column density by cloud in cell; pixels without particles have no row.

    What falls outside the image is dropped. compat: rows beyond the upper edge, and those just below the lower one,
    come in again from the other side. seen: gets the numbers of particles, of those deposited and of those outside when the deposit runs.
    """
    if seen is not None:
        px, py = to_pixel(F.col("x"), centre[0], lbox, width), to_pixel(F.col("y"), centre[1], lbox, height)
        # Cells are from the middle of one pixel to that of the next; compat takes rows from above the edge as well.
        on = (px >= -0.5) & (px < width + 0.5) & ((py >= 0.5 - height) if compat else (py >= -0.5) & (py < height + 0.5))
        df = df.observe(seen, *_counted(on))
    # A box length that varies is a key of its own; a fixed one is a factor at the end.
    varies = isinstance(lbox, Column)
    norm = F.lit(float(width)) * float(height) / (lbox * lbox)
    cell_keys = (*keys, "__n") if varies else keys
    axes = {"ix": to_pixel(F.col("x"), centre[0], lbox, width), "iy": to_pixel(F.col("y"), centre[1], lbox, height)}
    within = {"ix": (0, width - 1), "iy": (-height, None) if compat else (0, height - 1)}
    parts = _corners(_moments(df.withColumn("__n", norm) if varies else df, cell_keys, axes, within), cell_keys, ["ix", "iy"])
    weight = F.col("w") * F.col("__n") if varies else F.col("w") * norm
    inside = F.col("ix").between(0, width - 1)
    if compat:
        parts = parts.filter(inside & (F.col("iy") >= -height)).withColumn("iy", (F.col("iy") + height) % height)
    else:
        parts = parts.filter(inside & F.col("iy").between(0, height - 1))
    return parts.groupBy(*keys, "iy", "ix").agg(F.sum(weight).alias("rho"))


def cic_grid(df: DataFrame, n: int, low: tuple[Column | float, ...], span: tuple[Column | float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, iz, iy, ix, rho): unit masses on an n*n*n grid over a box; corners outside are dropped."""
    axes = {f"i{a}": (F.col(a) - lo) * n / s for a, lo, s in zip("xyz", low, span, strict=True)}
    parts = _corners(_moments(df, keys, axes, {a: (0, n - 1) for a in axes}), keys, list(axes))
    inside = F.col("ix").between(0, n - 1) & F.col("iy").between(0, n - 1) & F.col("iz").between(0, n - 1)
    return parts.filter(inside).groupBy(*keys, "iz", "iy", "ix").agg(F.sum("w").alias("rho"))


def _counted(on: Column, length: Column | None = None, max_px: float = 8.0, skip_px: float = 16.0) -> list[Column]:
    """Counters of a deposit. on: whether a particle reaches the image; length: in pixels, before any limit."""
    on = F.coalesce(on, F.lit(False))
    if length is None:
        return [F.count(F.lit(1)).alias("n_particles"), F.count_if(on).alias("n_deposited"), F.count_if(~on).alias("n_outside")]
    has = F.coalesce(length > 0, F.lit(False))
    fits = has & (length <= skip_px)
    return [
        F.count(F.lit(1)).alias("n_particles"), F.count_if(fits & on).alias("n_deposited"), F.count_if(fits & ~on).alias("n_outside"), F.count_if(~has).alias("n_without"),
        F.count_if(has & (length > skip_px)).alias("n_skipped"), F.count_if(fits & on & (length > max_px)).alias("n_capped"),
        *[F.count_if(in_band).alias(f"n {name}") for name, in_band in _bands(length).items()], *[F.sum(F.when(in_band, _writes(length)).otherwise(0)).alias(f"writes {name}") for name, in_band in _bands(length).items()],
    ]


def pixel_lengths(df: DataFrame, width: int, lbox: Column | float, max_px: float = 8.0, skip_px: float = 16.0) -> DataFrame:
    """Adds h_px, the smoothing length in pixels: rows without one or above skip_px go, the rest is cut to max_px or 1 % of the width."""
    h = F.col("h") * width / lbox
    return df.withColumn("h_px", h).filter((F.col("h") > 0) & (F.col("h_px") <= skip_px)).withColumn("h_px", F.least("h_px", F.lit(max(max_px, 0.01 * width))))


#: Rows of a strip of an image, at most and at least; particles that one task adds to a strip.
STRIP_ROWS, LEAST_ROWS, PART_ROWS = 64, 16, 1 << 22
#: Particles that are added together, and kernel values at once (few, to stay in the cache).
KERNEL_ROWS, KERNEL_VALUES = 1 << 17, 1 << 16


def sph_map(df: DataFrame, width: int, height: int, centre: tuple[float, float], lbox: Column | float, keys: tuple[str, ...] = (), max_px: float = 8.0, skip_px: float = 16.0, part_rows: int = PART_ROWS, seen: Observation | None = None) -> DataFrame:
    """(keys, iy, ix, rho): column density with the projected spline kernel; df has x, y and h.

    Each image is cut into strips of rows. Particles are dealt out by strip, with copies for those whose kernel reaches into
    the next one, and a strip is summed as an array by one task, so pixels have one owner and are not shuffled. Only where a strip
    has more than part_rows particles is it dealt to several tasks; then their pixels are summed by pixel. The particles are
    written once, as they are counted by strip first. seen: gets the counters of that pass, among them what is deposited, outside
    the image, without a length, skipped for a long one or cut to the longest (bands_seen reads those by band).
    """
    lbox = F.lit(float(lbox)) if not isinstance(lbox, Column) else lbox
    if seen is not None:
        length = F.coalesce(F.col("h"), F.lit(0.0)) * width / lbox
        most = max(max_px, 0.01 * width)
        far = F.ceil(2 * F.least(length, F.lit(most))) + 1
        px, py = to_pixel(F.col("x"), centre[0], lbox, width), to_pixel(F.col("y"), centre[1], lbox, height)
        df = df.observe(seen, *_counted((px > -far) & (px < width + far) & (py > -far) & (py < height + far), length, most, skip_px))
    norm = F.lit(float(width)) * float(height) / (lbox * lbox)
    p = pixel_lengths(df, width, lbox, max_px, skip_px).select(*keys, to_pixel(F.col("x"), centre[0], lbox, width).alias("px"), to_pixel(F.col("y"), centre[1], lbox, height).alias("py"), "h_px", norm.alias("__n"))
    # Particles that reach no pixel go first.
    reach = F.ceil(2 * F.col("h_px")) + 1
    p = staged(p.filter((F.col("px") > -reach) & (F.col("px") < width + reach) & (F.col("py") > -reach) & (F.col("py") < height + reach)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = max(LEAST_ROWS, min(STRIP_ROWS, -(-height // n)))
    first, last = F.floor((F.col("py") - reach) / rows), F.floor((F.col("py") + reach) / rows)
    strips = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit((height - 1) // rows)).cast("int"))
    dealt = p.select("*", F.explode(strips).alias("__strip"))
    # A row for each strip of each image.
    parts = dealt.groupBy(*keys, "__strip").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("__parts")).filter("__parts > 1")
    crowded = bool(parts.take(1))
    if crowded:
        # Null keys are images like others, so they are compared as equal.
        parts = staged(parts).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__strip").alias("__of"), "__parts")
        same = F.col("__strip") == F.col("__of")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
        dealt = dealt.join(parts, same, "left")
        dealt = dealt.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1))))
        dealt = dealt.repartition(n, *keys, "__strip", "__part")
    else:
        dealt = dealt.repartition(n, *keys, "__strip")
    dealt = dealt.select(*keys, "__strip", "px", "py", "h_px", "__n").sortWithinPartitions(*keys, "__strip")
    kinds = [t for c, t in dealt.dtypes if c in keys]
    schema = ", ".join([*[f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)], "iy int, ix int, rho double"])
    pixels = dealt.mapInArrow(_sph_strips(width, height, rows, len(keys)), schema)
    return pixels.groupBy(*keys, "iy", "ix").agg(F.sum("rho").alias("rho")) if crowded else pixels


def _sph_strips(width: int, height: int, rows: int, n_keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums particles, those of one strip after those of another, on an array of the strip; gives its pixels."""

    def add(image: np.ndarray, low: int, px: np.ndarray, py: np.ndarray, h: np.ndarray, norm: np.ndarray) -> None:
        reach, high = np.ceil(2 * h).astype(np.int64), min(height, low + rows)
        for r in np.unique(reach).tolist():
            # From row to row, so that a few particles touch a narrow band of the strip.
            own = np.flatnonzero(reach == r)
            own = own[np.argsort(py[own])]
            off = np.arange(-r, r + 1)
            step = max(1, KERNEL_VALUES // len(off) ** 2)
            for i in range(0, len(own), step):
                some = own[i : i + step]
                h2 = (h[some] * h[some])[:, None]
                ix, iy = (np.trunc(c[some]).astype(np.int64)[:, None] + off for c in (px, py))
                dx, dy = ix + 0.5 - px[some, None], iy + 0.5 - py[some, None]
                # Pixels beyond the strip are out of reach.
                dx2 = np.where((ix >= 0) & (ix < width), dx * dx, np.inf) / h2
                dy2 = np.where((iy >= low) & (iy < high), dy * dy, np.inf) / h2
                q2 = dy2[:, :, None] + dx2[:, None, :]
                near = np.flatnonzero(q2 < 4)
                if not len(near):
                    continue
                first, last = (max(low, int(iy[0, 0])) - low) * width, (min(high, int(iy[-1, -1]) + 1) - low) * width
                place = ((iy[:, :, None] - low) * width + ix[:, None, :]).ravel()[near] - first
                value = projected_array(q2.ravel()[near]) * (norm[some] / h2[:, 0])[near // len(off) ** 2]
                image[first:last] += np.bincount(place, value, minlength=last - first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, key, fields = None, None, None
        waiting: list[list[np.ndarray]] = []

        def draw() -> None:
            if waiting:
                add(image, key[-1] * rows, *(np.concatenate(c) for c in zip(*waiting, strict=True)))
                waiting.clear()

        def pixels() -> Iterator[pa.RecordBatch]:
            draw()
            cells = np.flatnonzero(image)
            for at in range(0, len(cells), 1 << 18):
                part = cells[at : at + (1 << 18)]
                held = [pa.array([k] * len(part), f.type) for k, f in zip(key[:-1], fields, strict=True)]
                columns = [*held, pa.array((key[-1] * rows + part // width).astype(np.int32)), pa.array((part % width).astype(np.int32)), pa.array(image[part])]
                yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in fields], "iy", "ix", "rho"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(k) for k in range(n_keys)]
            named = list(zip(*[batch.column(k).to_pylist() for k in range(n_keys + 1)], strict=True))
            ends = [i + 1 for i in range(batch.num_rows - 1) if named[i] != named[i + 1]] + [batch.num_rows]
            columns = [batch.column(n_keys + 1 + c).to_numpy(zero_copy_only=False) for c in range(4)]
            start = 0
            for end in ends:
                if image is None or named[start] != key:
                    if image is not None:
                        yield from pixels()
                    image, key = np.zeros(width * rows), named[start]
                waiting.append([c[start:end] for c in columns])
                if sum(len(w[0]) for w in waiting) >= KERNEL_ROWS:
                    draw()
                start = end
        if image is not None:
            yield from pixels()

    return run


def sph_grid(df: DataFrame, n: int, centre: tuple[float, float, float], lbox: float, max_px: float = 8.0, skip_px: float = 16.0) -> DataFrame:
    """(iz, iy, ix, rho): mass density on a grid with the three-dimensional spline, whose support is one h."""
    p = pixel_lengths(df, n, float(lbox), max_px, skip_px)
    p = p.select(*[to_pixel(F.col(a), c, float(lbox), n).alias(f"p{a}") for a, c in zip("xyz", centre, strict=True)], "h_px")
    reach = F.ceil("h_px").cast("int")

    def span(a: str) -> Column:
        lo, hi = F.greatest(F.lit(0), F.floor(f"p{a}").cast("int") - reach), F.least(F.lit(n - 1), F.floor(f"p{a}").cast("int") + reach)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    for a in "zyx":
        p = p.select("*", F.explode(span(a)).alias(f"i{a}"))
    r2 = sum(((F.col(f"i{a}") + 0.5 - F.col(f"p{a}")) * (F.col(f"i{a}") + 0.5 - F.col(f"p{a}")) for a in "xyz"), F.lit(0.0))
    p = p.withColumn("u", F.sqrt(r2) / F.col("h_px")).filter("u < 1")
    return p.groupBy("iz", "iy", "ix").agg(F.sum(spline_3d(F.col("u")) / (F.col("h_px") * F.col("h_px") * F.col("h_px"))).alias("rho"))


def _bands(h: Column) -> dict[str, Column]:
    """Bands of lengths in pixels; each length is in one."""
    return {"zero": h <= 0, "below 2": (h > 0) & (h < 2), "2 to 8": (h >= 2) & (h < 8), "8 to 16": (h >= 8) & (h <= 16), "above 16": h > 16}


def _writes(h: Column) -> Column:
    """Pixels that a kernel of this length writes."""
    side = 2 * F.ceil(2 * h) + 1
    return F.when(h > 0, side * side).otherwise(0).cast("long")


def h_bands(df: DataFrame, width: int, lbox: float) -> DataFrame:
    """(band, n, pixel_writes): how many smoothing lengths are zero, below 2, to 8, to 16 and above 16 pixels, and the pixels they write."""
    h = F.coalesce(F.col("h"), F.lit(0.0)) * width / lbox
    band = F.coalesce(*[F.when(inside, name) for name, inside in _bands(h).items()])
    return df.select(band.alias("band"), _writes(h).alias("w")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("pixel_writes"))


def bands_seen(counted: dict[str, int]) -> list[tuple[str, int, int]]:
    """The bands of h_bands from the counters of a kernel deposit; bands without a length are left out."""
    names = [k[2:] for k in counted if k.startswith("n ")]
    return [(b, counted[f"n {b}"], counted[f"writes {b}"]) for b in names if counted[f"n {b}"]]
