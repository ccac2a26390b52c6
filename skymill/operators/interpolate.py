"""Positions between snapshots: matching by id, and cubic or linear motion in a periodic box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AXES, minimum_image, wrap_position


def one_per_id(df: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row for each id (or other keys), so that a match never multiplies rows; of several the one with the least hash stays.

    Numbers only are aggregated, which Spark does by hash tables without sorting.
    """
    rows = df.select(*keys, *AXES, "ptype", F.xxhash64(*AXES, "ptype").alias("__h"))
    return rows.groupBy(*keys).agg(*[F.min_by(c, "__h").alias(c) for c in (*AXES, "ptype")])


def match_by_id(a: DataFrame, keys: tuple[str, ...] = ("id",), **others: DataFrame) -> DataFrame:
    """All rows of a with each other snapshot's position (x_name, y_name, z_name), null where the id is absent there.

    All joins are on the same key, so a is shuffled once and each other snapshot once.
    """
    out = a
    for name, other in others.items():
        right = one_per_id(other, keys).select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in AXES], F.lit(True).alias(f"has_{name}"))
        out = out.join(right, list(keys), "left")
    return out.withColumns({f"has_{name}": F.coalesce(f"has_{name}", F.lit(False)) for name in others})


def match_in_order(rows: DataFrame, **steps: int) -> DataFrame:
    """As match_by_id, from one table of all snapshots (id, place, x, y, z) with one row for each id and place at most.

    steps: how many snapshots behind a row's own (before it, if negative) each other one lies. Rows look along their own id, so the
    table is read once, and stays where it is if it is bucketed by id. An id has as many rows as there are snapshots.
    """
    along = Window.partitionBy("id").orderBy("place")
    reach = sorted({k if step > 0 else -k for step in steps.values() for k in range(1, abs(step) + 1)})
    seen = rows.withColumns({f"__at{k}": F.lead(F.struct("place", *AXES), k).over(along) for k in reach})
    out = {}
    for name, step in steps.items():
        near = [F.col(f"__at{k if step > 0 else -k}") for k in range(1, abs(step) + 1)]
        found = F.coalesce(*[F.when(s["place"] == F.col("place") + step, s) for s in near])
        out |= {f"{c}_{name}": found[c] for c in AXES} | {f"has_{name}": found.isNotNull()}
    return seen.withColumns(out).drop(*[f"__at{k}" for k in reach])


def hermite_basis(t: Column) -> tuple[Column, Column, Column, Column]:
    """Weights of start, start slope, end and end slope."""
    t2, t3 = t * t, t * t * t
    return 2 * t3 - 3 * t2 + 1, t3 - 2 * t2 + t, 3 * t2 - 2 * t3, t3 - t2


def extrapolate(df: DataFrame, frac: float, dt: float = 0.0) -> DataFrame:
    """Positions moved along their velocities by frac * dt, or by frac if dt is not positive."""
    step = frac * dt if dt > 0 else frac
    return df.withColumns({a: F.col(a) + step * F.col(f"v{a}") for a in AXES}) if frac else df


def hermite(matched: DataFrame, t: Column, box: float) -> DataFrame:
    """Two-snapshot cubic through a and b, with slopes equal to the displacement; unmatched rows stay at a."""
    h00, h10, h01, h11 = hermite_basis(t)
    moved = {}
    for c in AXES:
        a, d = F.col(c), minimum_image(F.col(f"{c}_b") - F.col(c), box)
        moved[c] = F.when(F.col("has_b"), wrap_position(h00 * a + h10 * d + h01 * (a + d) + h11 * d, box)).otherwise(a)
    return matched.withColumns(moved)


def catmull_rom(matched: DataFrame, t: Column, box: float, with_next: bool) -> DataFrame:
    """Cubic through a and b with slopes from the neighbouring snapshots.

    The start slope is half the way from p to a, the end slope half the way from a to n (without n: half the way from a
    to b). A missing p makes the start slope half the way from a to b; rows without b stay at a.
    """
    h00, h10, h01, h11 = hermite_basis(t)
    moved = {}
    for c in AXES:
        a = F.col(c)
        d = minimum_image(F.col(f"{c}_b") - a, box)
        m0 = F.when(F.col("has_p"), minimum_image(a - F.col(f"{c}_p"), box) / 2).otherwise(d / 2)
        m1 = F.when(F.col("has_n"), minimum_image(F.col(f"{c}_n") - a, box) / 2).otherwise(d / 2) if with_next else d / 2
        moved[c] = F.when(F.col("has_b"), wrap_position(h00 * a + h10 * m0 + h01 * (a + d) + h11 * m1, box)).otherwise(a)
    return matched.withColumns(moved)
