"""Selection of particles by type and by a periodic view cube; counts, bounds and octants."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import types_of
from ..schema import AXES, minimum_image


def type_filter(mask: int) -> Column:
    """Types whose bit is set, as a list of values so that scans can skip; -1 selects all."""
    types = types_of(mask)
    return F.lit(True) if types is None else F.col("ptype").isin(types)


#: Plain bounds are wider than the exact test by this share of the box, so that rounding loses no row.
SLACK = 1e-9


def cube_filter(centre: tuple[float, float, float], lbox: float, box: float) -> Column:
    """Within lbox/2 of the centre on each axis, edges excluded, by the nearest periodic image.

    A cube smaller than the box is also given as plain bounds: on each axis those of the cube and of its images one period
    to either side, which together are the boxes into which the edge cuts the cube. Scans push them down and skip row groups.
    """
    if not lbox > 0:
        raise ValueError("lbox must be positive")
    tests, reach = [], lbox / 2 + SLACK * box
    for axis, c in zip(AXES, centre, strict=True):
        p = F.col(axis)
        if lbox < box:
            tests.append(reduce(or_, [(p >= c + shift - reach) & (p <= c + shift + reach) for shift in (0, -box, box)]))
        tests.append(F.abs(2 * minimum_image(p - c, box) / lbox) < 1)
    return reduce(and_, tests)


def select_view(df: DataFrame, mask: int, centre: tuple[float, float, float], lbox: float, box: float) -> DataFrame:
    return df.filter(type_filter(mask)).filter(cube_filter(centre, lbox, box))


def unwrap_to_view(df: DataFrame, centre: tuple[float, float, float], box: float) -> DataFrame:
    """Positions moved to the image nearest to the centre, so that what was selected across the edge is drawn."""
    return df.withColumns({a: c + minimum_image(F.col(a) - c, box) for a, c in zip(AXES, centre, strict=True)})


def count_types(df: DataFrame, *by: str) -> DataFrame:
    """Rows for each combination of by and ptype, each by, and in total (nulls mark totals)."""
    return df.rollup(*by, "ptype").agg(F.count(F.lit(1)).alias("n"))


def type_boundaries(df: DataFrame) -> DataFrame:
    """(ptype, n, first_row, end_row) if rows were stored type by type. One row for each type is windowed."""
    counts = df.groupBy("ptype").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.orderBy("ptype").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("ptype", "n", (end - F.col("n")).alias("first_row"), end.alias("end_row"))


def missing_types(df: DataFrame, mask: int) -> DataFrame:
    """Types that the mask names but no row has."""
    spark, types = df.sparkSession, types_of(mask) or []
    wanted = spark.createDataFrame([(t,) for t in types], "ptype int")
    return wanted.join(df.select("ptype").distinct(), "ptype", "left_anti")


def bounds(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Least and greatest value on each axis, and the number of rows."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max))])


def octant(middle: tuple[float, float, float]) -> Column:
    """Which eighth of a box a position lies in: a bit for each axis on which it is above the middle."""
    return sum(((F.col(a) > m).cast("int") * (1 << i) for i, (a, m) in enumerate(zip(AXES, middle, strict=True))), F.lit(0))


def octant_counts(df: DataFrame, middle: tuple[float, float, float]) -> DataFrame:
    """(octant, n, mean position) of each octant with rows."""
    return df.groupBy(octant(middle).alias("octant")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in AXES])
