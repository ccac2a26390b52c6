"""Time between snapshots from their scale factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Km in a Mpc, seconds in a Gyr.
KM_PER_MPC = 3.085677581e19
SECONDS_PER_GYR = 3.15576e16


def hubble_ratio(a: Column, omega_m: float, omega_l: float, omega_k: float = 0.0) -> Column:
    """H(a) / H0."""
    return F.sqrt(omega_m / (a * a * a) + omega_k / (a * a) + omega_l)


def snapshot_interval(spark: SparkSession, a1: float, a2: float, h0: float = 67.74, omega_m: float = 0.309, omega_l: float = 0.691, h: float | None = None, steps: int = 10_000) -> DataFrame:
    """One row (dt_s, snap_dt, dt_gyr): the time from a1 to a2 by the midpoint rule, also in (Mpc/h)/(km/s) and in Gyr."""
    if not 0 < a1 < a2:
        raise ValueError("scale factors must satisfy 0 < a1 < a2")
    da = (a2 - a1) / steps
    a = a1 + (F.col("id") + 0.5) * da
    dt = F.sum(da / (a * hubble_ratio(a, omega_m, omega_l) * (h0 / KM_PER_MPC)))
    out = spark.range(steps).agg(dt.alias("dt_s"))
    return out.withColumns({"snap_dt": F.col("dt_s") * (h if h is not None else h0 / 100) / KM_PER_MPC, "dt_gyr": F.col("dt_s") / SECONDS_PER_GYR})


def scale_factor(redshift: float) -> float:
    return 1 / (1 + redshift)
