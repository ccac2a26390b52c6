"""Smoothing kernels as column expressions."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positive nodes of 16-point Gauss-Legendre quadrature on [-1, 1] and their weights.
GL_NODES = (0.0950125098360373, 0.2816035507792589, 0.4580167776572274, 0.6178762444026438, 0.7554044083550030, 0.8656312023341108, 0.9445750230732326, 0.9894009349916499)
GL_WEIGHTS = (0.1894506104550685, 0.1826034150449236, 0.1691565193950025, 0.1495959888165767, 0.1246289712555339, 0.0951585116824928, 0.0622535239386479, 0.0271524594117541)


def spline_3d(u: Column) -> Column:
    """Cubic spline with support u < 1, normalised in three dimensions."""
    inner = 6 * u * u * (u - 1) + 1
    outer = 2 * (1 - u) * (1 - u) * (1 - u)
    return 8 / math.pi * F.when(u < 0.5, inner).when(u < 1, outer).otherwise(0.0)


def spline_3d_array(u: np.ndarray) -> np.ndarray:
    """spline_3d of an array, as a sum of cubes without branches."""
    far, near = np.maximum(1 - u, 0), np.maximum(0.5 - u, 0)
    return 16 / math.pi * (far * far * far - 4 * (near * near * near))


def _profile(u: Column) -> Column:
    """Cubic spline with support u < 2, without its factor 1/pi.

    Both pieces as one sum of cubes: without branches Spark evaluates u once.
    """
    near, far = F.greatest(1 - u, F.lit(0.0)), F.greatest(2 - u, F.lit(0.0))
    return 0.25 * far * far * far - near * near * near


def projected_q2(q2: Column) -> Column:
    """The spline integrated along the line of sight, as a function of the squared projected distance in units of h.

    The integrand is even, so eight of the sixteen nodes are summed twice.
    """
    half = F.sqrt(F.greatest(4 - q2, F.lit(0.0)))
    total = F.lit(0.0)
    for x, w in zip(GL_NODES, GL_WEIGHTS, strict=True):
        total = total + 2 * w * _profile(F.sqrt(q2 + (4 - q2) * (x * x)))
    return half * total / math.pi


@cache
def projected_table(n: int = 1 << 16) -> np.ndarray:
    """projected_q2 at n + 1 even steps over [0, 4], with one more before and two after."""
    q2 = np.arange(-1, n + 3) * (4 / n)
    total = np.zeros(len(q2))
    for x, w in zip(GL_NODES, GL_WEIGHTS, strict=True):
        u = np.sqrt(q2 + (4 - q2) * (x * x))
        total += 2 * w * (0.25 * np.maximum(2 - u, 0) ** 3 - np.maximum(1 - u, 0) ** 3)
    return np.sqrt(np.maximum(4 - q2, 0)) * total / math.pi


def projected_array(q2: np.ndarray) -> np.ndarray:
    """projected_q2 of an array of values in [0, 4), by cubics through four rows of the table: to some 1e-13."""
    table = projected_table()
    at = q2 * ((len(table) - 4) / 4)
    i = at.astype(np.int64)
    t = at - i
    a, b, c, d = (table[i + k] for k in range(4))
    return b + 0.5 * t * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a)))


def projected(q: Column) -> Column:
    return projected_q2(q * q)


def cumulative(u: Column) -> Column:
    """Integral of the spline with support 2 along a line from the centre to u."""
    inner = u - 0.5 * u * u * u + 3 / 16 * u * u * u * u
    outer = 0.6875 + 2 * u - 1.5 * u * u + 0.5 * u * u * u - u * u * u * u / 16 - 0.9375
    return F.when(u < 1, inner).when(u < 2, outer).otherwise(0.75) / math.pi


def kernel_table(spark: SparkSession, which: str, n: int) -> DataFrame:
    """(i, u, value) of a kernel at n evenly spaced points over its support."""
    kernel, top = {"spline_3d": (spline_3d, 1.0), "projected": (projected, 2.0), "cumulative": (cumulative, 2.0)}[which]
    u = F.col("i") * F.lit(top / (n - 1))
    return spark.range(n).select(F.col("id").cast("int").alias("i")).select("i", u.alias("u")).withColumn("value", kernel(F.col("u")))


def lookup(values: list[float], top: float, u: Column) -> Column:
    """Linear interpolation in a table over [0, top]; zero beyond."""
    table, n = F.array(*[F.lit(float(v)) for v in values]), len(values)
    at = u * F.lit((n - 1) / top)
    i = F.least(F.floor(at).cast("int"), F.lit(n - 2))
    low = F.get(table, i)
    return F.when(u < top, low + (at - i) * (F.get(table, i + 1) - low)).otherwise(0.0)
