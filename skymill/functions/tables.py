"""Deposits for SQL text: table functions that turn particles into the pixels they touch.

    SELECT iy, ix, sum(rho) AS rho
    FROM kernel_footprints(TABLE(SELECT frame, px, py, h_px, weight, part FROM particles) PARTITION BY part)
    WHERE iy BETWEEN 0 AND 767 AND ix BETWEEN 0 AND 767 GROUP BY iy, ix

They read Arrow batches, as a lateral join row by row would not, and need their table dealt out: without PARTITION BY all of it meets
in one task. Any even column does, such as a row number modulo some number of parts, since pixels of several parts are summed afterwards. Pixels
are already summed within some 2^18 values, and not cut at the edges of an image.
Particles are (frame, px, py, h_px, weight), positions and lengths in pixels (the stencil has no h_px); those with a null, or without a positive length, touch nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .kernels import projected_array

PIXELS = "frame int, iy int, ix int, rho double"
#: Values of footprints that are summed at once.
VALUES = 1 << 18


def _columns(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns of the rows that have all of them."""
    table = pa.table({n: rows.column(n) for n in ("frame", *names)}).drop_null()
    return [table["frame"].to_numpy().astype(np.int64), *[pc.cast(table[n], pa.float64()).to_numpy() for n in names]]


def _summed(frame: np.ndarray, iy: np.ndarray, ix: np.ndarray, value: np.ndarray) -> pa.Table:
    """One row for each pixel."""
    order = np.lexsort((ix, iy, frame))
    frame, iy, ix, value = (c[order] for c in (frame, iy, ix, value))
    new = np.ones(len(frame), bool)
    new[1:] = (np.diff(frame) != 0) | (np.diff(iy) != 0) | (np.diff(ix) != 0)
    at = np.flatnonzero(new)
    total = np.add.reduceat(value, at) if len(at) else value
    return pa.table([*[pa.array(c[at].astype(np.int32)) for c in (frame, iy, ix)], pa.array(total, pa.float64())], ["frame", "iy", "ix", "rho"])


class KernelFootprints:
    """The projected spline kernel of each particle, times weight over the square of its length, on the pixels within two lengths."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        frame, px, py, h, weight = _columns(rows, "px", "py", "h_px", "weight")
        reach = np.where(h > 0, np.ceil(2 * np.maximum(h, 0)), -1).astype(np.int64)
        for r in np.unique(reach[reach >= 0]).tolist():
            own, off = np.flatnonzero(reach == r), np.arange(-r, r + 1)
            step = max(1, VALUES // len(off) ** 2)
            for i in range(0, len(own), step):
                some = own[i : i + step]
                ix, iy = (np.trunc(c[some]).astype(np.int64)[:, None] + off for c in (px, py))
                dx, dy = ix + 0.5 - px[some, None], iy + 0.5 - py[some, None]
                q2 = (dy[:, :, None] ** 2 + dx[:, None, :] ** 2) / (h[some] ** 2)[:, None, None]
                k, y, x = np.nonzero(q2 < 4)
                value = projected_array(q2[k, y, x]) * (weight[some] / h[some] ** 2)[k]
                yield _summed(frame[some][k], iy[k, y], ix[k, x], value)


class CellStencils:
    """Each particle's weight, dealt to the four pixels around it by cloud in cell."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        frame, px, py, weight = _columns(rows, "px", "py", "weight")
        cx, cy = np.floor(px - 0.5).astype(np.int64), np.floor(py - 0.5).astype(np.int64)
        tx, ty = px - (cx + 0.5), py - (cy + 0.5)
        parts = [(cy + b, cx + a, weight * (tx if a else 1 - tx) * (ty if b else 1 - ty)) for b in (0, 1) for a in (0, 1)]
        yield _summed(np.tile(frame, 4), *(np.concatenate(c) for c in zip(*parts, strict=True)))


FUNCTIONS = {"kernel_footprints": KernelFootprints, "cell_stencils": CellStencils}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, arrow_udtf(cls, returnType=PIXELS))
