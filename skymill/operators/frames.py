"""Frames as a table: interpolation time, rotation and zoom; numbering of frames over a sequence of snapshots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RenderConfig
from ..schema import AXES, FRAMES

#: More frames than this are not broadcast but joined by Spark's own choice.
BROADCAST_FRAMES = 100_000


def frames_table(spark: SparkSession, cfg: RenderConfig) -> DataFrame:
    """(frame, t, angle_deg, lbox) of every frame of a render."""
    moving = cfg.mode != "single" and cfg.itmax > 1
    rows = [(i, float(i / (cfg.itmax - 1) if moving else cfg.interp_frac), float(i * cfg.rot_dangle), float(cfg.lbox * cfg.zoom_factor**i if cfg.zoom > 0 else cfg.lbox)) for i in range(cfg.frames)]
    return spark.createDataFrame(rows, FRAMES)


def with_frames(df: DataFrame, frames: DataFrame) -> DataFrame:
    """Every particle in every frame: all frames are one job. The frames are few, a row for each image asked for."""
    return df.crossJoin(F.broadcast(frames) if frames.count() <= BROADCAST_FRAMES else frames)


def rotate(df: DataFrame, centre: tuple[float, float, float], axis: tuple[float, float, float], angle: str = "angle_deg") -> DataFrame:
    """Positions turned about an axis through the centre, by Rodrigues' formula; the axis has length 1."""
    a = F.radians(F.col(angle))
    c, s = F.cos(a), F.sin(a)
    v = [F.col(n) - m for n, m in zip(AXES, centre, strict=True)]
    k = axis
    dot = k[0] * v[0] + k[1] * v[1] + k[2] * v[2]
    cross = (k[1] * v[2] - k[2] * v[1], k[2] * v[0] - k[0] * v[2], k[0] * v[1] - k[1] * v[0])
    return df.withColumns({n: centre[i] + v[i] * c + cross[i] * s + k[i] * dot * (1 - c) for i, n in enumerate(AXES)})


def snapshot_roles(snaps: DataFrame, mode: str) -> DataFrame:
    """(seq, roles...) of each interval: hermite a, b; catmull prev, a, b; catmull4 prev, a, b, next.

    snaps: (seq, root), a row for each snapshot, few enough to be ordered in one place.
    """
    roles = {"hermite": ("a", "b"), "catmull": ("prev", "a", "b"), "catmull4": ("prev", "a", "b", "next")}[mode]
    w = Window.orderBy("seq")
    out = snaps.select("seq", *[F.lead("root", i).over(w).alias(r) if i else F.col("root").alias(r) for i, r in enumerate(roles)])
    return out.filter(F.col(roles[-1]).isNotNull())


def global_frames(intervals: DataFrame, per_interval: int, output: str = "frame") -> DataFrame:
    """(seq, local, global_frame, file): frames of all intervals numbered through; the shared last frame of an interval is kept only at the end."""
    order = Window.orderBy("seq")
    last = F.lead("seq").over(order).isNull()
    keep = F.when(last, per_interval).otherwise(per_interval - 1)
    kept = intervals.withColumn("keep", keep)
    kept = kept.withColumn("before", F.sum("keep").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("keep"))
    out = kept.select("seq", "before", F.explode(F.sequence(F.lit(0), F.col("keep") - 1)).alias("local"))
    number = (F.col("before") + F.col("local")).cast("int")
    return out.select("seq", F.col("local").cast("int").alias("local"), number.alias("global_frame"), F.format_string(f"{output}.%04d.png", number).alias("file"))


def frame_total(n_snapshots: int, per_interval: int, mode: str) -> int:
    """Frames of a whole sequence."""
    k = n_snapshots - {"hermite": 1, "catmull": 2, "catmull4": 3}[mode]
    return k * (per_interval - 1) + 1 if k > 0 else 0


def unit_vector(x: float, y: float, z: float) -> tuple[float, float, float]:
    n = math.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n
