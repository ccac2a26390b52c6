"""Equal-count slabs along x, from a histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 8192


def slab_histogram(df: DataFrame, low: float, span: float, bins: int = BINS) -> DataFrame:
    """(bin, n): rows for each of the bins on x; outliers go to the end bins."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((F.col("x") - low) * bins / span).cast("int")))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def slab_splits(histogram: DataFrame, slabs: int, low: float, span: float, bins: int = BINS) -> DataFrame:
    """(slab, lo, hi, first_bin, end_bin): slab k ends at the right edge of the first bin where k/slabs of all rows are reached.

    Ends rise by at least a bin; the last slab ends at the box's edge. The histogram has at most `bins` rows.
    """
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = histogram.select("bin", F.sum("n").over(w).alias("cum"))
    total = histogram.agg(F.sum("n").alias("total"))
    wanted = histogram.sparkSession.range(1, slabs).select(F.col("id").cast("int").alias("slab")).crossJoin(F.broadcast(total))
    # At most slabs * bins rows.
    ends = wanted.join(F.broadcast(cum), F.col("cum") * slabs >= F.col("slab") * F.col("total"), "left").groupBy("slab").agg(F.coalesce(F.min("bin") + 1, F.lit(bins)).alias("end"))
    # Strictly rising: the running maximum of (end - slab), plus slab.
    rising = F.max(F.col("end") - F.col("slab")).over(Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, 0)) + F.col("slab")
    ends = ends.select("slab", F.least(rising, F.lit(bins)).cast("int").alias("end_bin"))
    ends = ends.unionByName(histogram.sparkSession.createDataFrame([(slabs, bins)], "slab int, end_bin int"))
    first = F.coalesce(F.lag("end_bin").over(Window.orderBy("slab")), F.lit(0))
    out = ends.select((F.col("slab") - 1).alias("slab"), first.cast("int").alias("first_bin"), "end_bin")
    edge = lambda c: low + F.col(c) * (span / bins)
    return out.select("slab", edge("first_bin").alias("lo"), edge("end_bin").alias("hi"), "first_bin", "end_bin")


def assign_slabs(df: DataFrame, splits: DataFrame) -> DataFrame:
    """df and slab: the first slab that ends above x; what lies beyond all, or nowhere, goes to the last. One row for each slab is collected.

    The slab is found by halving the list of ends, so the expression does not grow with the slabs.
    """
    ends = [r["hi"] for r in splits.orderBy("slab").collect()][:-1]
    last = len(ends)
    if not last:
        return df.withColumn("slab", F.lit(0))
    steps = [1 << k for k in reversed(range(last.bit_length()))]
    held, x = F.lit(ends), F.col("x")
    # How many ends lie at or below x.
    below = F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(F.get(held, n + step - 1) <= x, n + step).otherwise(n))
    return df.withColumn("slab", F.when(x.isNull(), last).otherwise(below).cast("int"))
