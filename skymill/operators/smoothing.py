"""Smoothing lengths of particles: from a density grid, from leaves of a spatial tree, or from exact neighbours."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AXES
from ..staging import staged
from .deposit import cic_grid
from .tree import SUBTREE_ROWS, at_places, leaves, nearest_places

#: The box around all particles is widened by this on each side before it is cut into a grid.
PAD = 1e-4


def box_mean(grid: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, iz, iy, ix, rho): mean over the 3*3*3 cells around each cell, of those inside the grid; cells with an empty surrounding have no row."""
    spread = grid
    for a in ("iz", "iy", "ix"):
        others = [c for c in ("iz", "iy", "ix") if c != a]
        spread = spread.select(*keys, *others, "rho", F.explode(F.array(F.col(a) - 1, F.col(a), F.col(a) + 1)).alias(a)).filter(F.col(a).between(0, n - 1)).groupBy(*keys, "iz", "iy", "ix").agg(F.sum("rho").alias("rho"))

    def width(a: str) -> Column:
        return 3 - (F.col(a) == 0).cast("int") - (F.col(a) == n - 1).cast("int")

    return spread.withColumn("rho", F.col("rho") / (width("iz") * width("iy") * width("ix")))


def sample_grid(df: DataFrame, grid: DataFrame, n: int, low: tuple[Column | float, ...], span: tuple[Column | float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """df (with id) and rho: the grid's values at each position by trilinear weights.

    The grid has at most n**3 cells (for each key), whatever the number of particles; Spark broadcasts it if it is small enough.
    """
    p = {a: (F.col(a) - lo) * n / s for a, lo, s in zip(AXES, low, span, strict=True)}
    base = df.withColumns({f"c{a}": F.floor(x - 0.5).cast("int") for a, x in p.items()})
    base = base.withColumns({f"t{a}": x - (F.col(f"c{a}") + 0.5) for a, x in p.items()})
    corners = []
    for i in range(8):
        up = {a: i >> k & 1 for k, a in enumerate(AXES)}
        w = F.lit(1.0)
        for a in AXES:
            w = w * (F.col(f"t{a}") if up[a] else 1 - F.col(f"t{a}"))
        corners.append(F.struct(*[(F.col(f"c{a}") + up[a]).alias(f"i{a}") for a in AXES], w.alias("w")))
    rows = base.select("id", *keys, F.explode(F.array(*corners)).alias("k")).select("id", *keys, "k.*")
    got = rows.join(grid, [*keys, "ix", "iy", "iz"], "left").groupBy("id", *keys).agg(F.sum(F.col("w") * F.coalesce("rho", F.lit(0.0))).alias("rho"))
    return df.join(got, ["id", *keys])


#: Cells of a grid that a task may hold as an array, and that are broadcast (32 MB); larger grids are tables.
DENSE_CELLS = 1 << 22


def _corners(xyz: np.ndarray, n: int, low: np.ndarray, span: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of a cell's eight corners: which positions have it inside the grid, its cell number, and the weight there."""
    p = (xyz - low) * n / span
    base = np.floor(p - 0.5).astype(np.int64)
    t = p - (base + 0.5)
    for corner in product((0, 1), repeat=3):
        cell = base + corner
        inside = ((cell >= 0) & (cell < n)).all(1)
        weight = np.where(corner, t, 1 - t).prod(1)
        yield inside, ((cell[:, 2] * n + cell[:, 1]) * n + cell[:, 0])[inside], weight[inside]


def dense_grid(df: DataFrame, n: int, low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Unit masses on an n*n*n grid, z first: summed in each task, then by cell; at most n**3 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(n**3)
        for batch in batches:
            xyz = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            for _, cell, weight in _corners(xyz, n, low, span):
                np.add.at(grid, cell, weight)
        cells = np.flatnonzero(grid)
        for at in range(0, len(cells), 1 << 18):
            part = cells[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(grid[part])], ["cell", "w"])

    got = df.select(*AXES).mapInArrow(run, "cell long, w double").groupBy("cell").agg(F.sum("w").alias("w")).toArrow()
    grid = np.zeros(n**3)
    grid[got["cell"].to_numpy()] = got["w"].to_numpy()
    return grid.reshape(n, n, n)


def dense_mean(grid: np.ndarray) -> np.ndarray:
    """Mean over the 3*3*3 cells around each cell, of those inside the grid."""
    total, count = grid, np.ones(grid.shape)
    for axis in range(3):
        total, count = (sum(np.roll(np.pad(x, [(1, 1) if a == axis else (0, 0) for a in range(3)]), d, axis) for d in (-1, 0, 1)).take(range(1, grid.shape[axis] + 1), axis) for x in (total, count))
    return total / count


def _bounds(df: DataFrame, *keys: str) -> DataFrame:
    ends = [x for a in AXES for x in ((F.min(a) - PAD).alias(f"__l{a}"), (F.max(a) - F.min(a) + 2 * PAD).alias(f"__s{a}"))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *ends)


def grid_lengths(df: DataFrame, lbox: float, n: int = 128, num_ngb: int = 32, eta: float = 1.2, min_frac: float = 0.1, max_voxels: float = 8.0, group: str | None = None) -> DataFrame:
    """df (with id) and h from a smoothed density grid; null where the density is below min_frac of the mean.

    h is at most max_voxels * lbox / 768, whatever the image's resolution. group: a column with a grid for each of its
    values. One grid of up to DENSE_CELLS is an array that each task reads; else grids are tables that are joined.
    """
    most = max_voxels * lbox / 768
    if group is None and n**3 <= DENSE_CELLS:
        return _dense_lengths(df, n, num_ngb, eta, min_frac, most)
    keys = () if group is None else (group,)
    low, span = [f"__l{a}" for a in AXES], [f"__s{a}" for a in AXES]
    # One row, or one for each value of the group.
    bounds = F.broadcast(_bounds(df, *keys))
    placed = df.join(bounds, list(keys)) if keys else df.crossJoin(bounds)
    lows, spans = tuple(map(F.col, low)), tuple(map(F.col, span))
    grid = box_mean(cic_grid(placed, n, lows, spans, keys), n, keys)
    cell = spans[0] * spans[1] * spans[2] / n**3
    factor = eta * F.cbrt(3 * num_ngb * cell / (4 * math.pi))
    found = sample_grid(placed, grid, n, lows, spans, keys)
    h = F.when(F.col("rho") >= min_frac * F.col("__n") / n**3, F.least(factor / F.cbrt("rho"), F.lit(most)))
    return found.withColumn("h", h).drop("rho", "__n", *low, *span)


def _dense_lengths(df: DataFrame, n: int, num_ngb: int, eta: float, min_frac: float, most: float) -> DataFrame:
    b = _bounds(df).first()
    if not b["__n"]:
        return df.withColumn("h", F.lit(None).cast("double"))
    low, span = (np.array([b[f"__{k}{a}"] for a in AXES]) for k in "ls")
    held = df.sparkSession.sparkContext.broadcast(dense_mean(dense_grid(df, n, low, span)).ravel())
    factor, least = eta * (3 * num_ngb * span.prod() / n**3 / (4 * math.pi)) ** (1 / 3), min_frac * b["__n"] / n**3

    @F.pandas_udf("double")
    def length(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        xyz = np.stack([x, y, z], 1)
        rho = np.zeros(len(xyz))
        for inside, cell, weight in _corners(xyz, n, low, span):
            rho[inside] += weight * held.value[cell]
        h = np.minimum(factor / np.cbrt(np.maximum(rho, 1e-300)), most)
        return pd.Series(np.where(rho >= least, h, -1.0))

    # Evaluated once for each particle, as a column of its own.
    found = df.withColumn("h", length(*AXES))
    return found.withColumn("h", F.when(F.col("h") >= 0, F.col("h")))


def place_lengths(df: DataFrame, lbox: float, width: int, num_ngb: int = 32, eta: float = 1.2, max_voxels: float = 8.0, group: str | None = None) -> DataFrame:
    """(grp, x, y, z, copies, h): every place of the particles once, with how many lie there and their length by knn_lengths. No ids are needed."""
    h = F.least(eta * F.sqrt("r2"), F.lit(max_voxels * lbox / width))
    return nearest_places(df, num_ngb, group=group).select("grp", *AXES, "copies", F.when(F.col("n") >= num_ngb, h).alias("h"))


def knn_lengths(df: DataFrame, lbox: float, width: int, num_ngb: int = 32, eta: float = 1.2, max_voxels: float = 8.0, group: str | None = None) -> DataFrame:
    """df and h = eta times the distance to the num_ngb-th neighbour, the particle itself counted; null if there are fewer."""
    return at_places(df, place_lengths(df, lbox, width, num_ngb, eta, max_voxels, group).drop("copies"), group)


def leaf_lengths(df: DataFrame, lbox: float, width: int, num_ngb: int = 32, eta: float = 1.2, leaf_size: int = 32, max_voxels: float = 8.0, subtree_rows: int = SUBTREE_ROWS, group: str | None = None) -> DataFrame:
    """df (with id) and h from the density of the particle's leaf: its count over the volume of its bounding box, flat axes left out."""
    placed = staged(leaves(df, leaf_size, subtree_rows, group))
    volume = F.lit(1.0)
    for a in AXES:
        span = F.max(a) - F.min(a)
        volume = volume * F.when(span > 1e-10, span).otherwise(1.0)
    density = placed.groupBy("node", "leaf").agg((F.count(F.lit(1)) / (volume + 1e-30)).alias("density"))
    h = F.least(eta * F.cbrt(num_ngb / (F.col("density") * (4 / 3 * math.pi))), F.lit(max_voxels * lbox / width))
    keys = [] if group is None else [group]
    return df.join(placed.join(density, ["node", "leaf"]).select("id", *[F.col("grp").alias(g) for g in keys], h.alias("h")), ["id", *keys])


def smoothing_lengths(df: DataFrame, method: str, lbox: float, width: int, num_ngb: int = 32, eta: float = 1.2, **options) -> DataFrame:
    """df and h by one of the methods grid, leaf and knn. group (an option): a column within whose values particles count."""
    if method == "grid":
        return grid_lengths(df, lbox, num_ngb=num_ngb, eta=eta, **options)
    return {"leaf": leaf_lengths, "knn": knn_lengths}[method](df, lbox, width, num_ngb=num_ngb, eta=eta, **options)


def cached_lengths(df: DataFrame, path: str, method: str, lbox: float, width: int, **options) -> DataFrame:
    """smoothing_lengths kept as a table at path, below a name made of all settings and a digest of the particles."""
    spark: SparkSession = df.sparkSession
    digest = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", *AXES).cast("decimal(38,0)"))).first()
    name = f"{path}/{_key(method, lbox, width, options, digest)}"
    try:
        lengths = spark.read.parquet(name)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        smoothing_lengths(df, method, lbox, width, **options).select("id", "h").write.parquet(name)
        lengths = spark.read.parquet(name)
    return df.join(lengths, "id")


def _key(*parts) -> str:
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:24]
