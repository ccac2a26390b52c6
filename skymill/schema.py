"""Schemas of the particle tables, and the views over the test tables that stand for snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTICLES = "id long, ptype int, x double, y double, z double, vx double, vy double, vz double"
HEADER = "file string, num_types int, npart array<long>, nall array<long>, massarr array<double>, time double, redshift double, num_files int, box_size double, omega0 double, omega_lambda double, hubble double"
FRAMES = "frame int, t double, angle_deg double, lbox double"
PIXELS = "frame int, iy int, ix int, rho double"
AXES = ("x", "y", "z")


def wrap_position(p: Column, box: float) -> Column:
    """A position moved by one period into [0, box)."""
    return F.when(p < 0, p + box).when(p >= box, p - box).otherwise(p)


def minimum_image(d: Column, box: float) -> Column:
    """A displacement moved by one period into [-box/2, box/2]."""
    return F.when(d > box / 2, d - box).when(d < -box / 2, d + box).otherwise(d)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _part(i: int) -> Column:
    return F.get("embedding", F.lit(i)).cast("double")


def particles_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles from the first six components of the vectors, in a box of length 1."""
    return _vectors(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.pmod("label", F.lit(6)).cast("int").alias("ptype"), *[(_part(i) + 0.5).alias(a) for i, a in enumerate(AXES)], *[_part(3 + i).alias(f"v{a}") for i, a in enumerate(AXES)]
    )


def _moved(spark: SparkSession, sf_dir: str, scale: float, first: int, modulus: int, gone: int) -> DataFrame:
    moved = [wrap_position(_part(i) + 0.5 + scale * _part(first + i), 1.0).alias(a) for i, a in enumerate(AXES)]
    return _vectors(spark, sf_dir).filter(F.pmod("vec_id", F.lit(modulus)) != gone).select(F.col("vec_id").alias("id"), F.pmod("label", F.lit(6)).cast("int").alias("ptype"), *moved)


def snap_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles_emb(spark, sf_dir).select("id", "ptype", *AXES)


def snap_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, 1.5, 6, 7, 3)


def snap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, -1.2, 9, 11, 5)


def snap_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, 1.8, 12, 13, 4)


def particles_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles from events: time of the month, value and user."""
    kinds = F.create_map(*[F.lit(x) for kv in (("click", 0), ("error", 1), ("purchase", 2), ("signup", 3), ("view", 4)) for x in kv])
    seconds = (F.dayofmonth("ts") - 1) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.try_element_at(kinds, F.col("event_type")).cast("int").alias("ptype"),
        (seconds / F.lit(2592e3)).alias("x"), (F.col("value") / F.lit(5e2)).alias("y"), ((F.pmod("user_id", F.lit(100)) + F.lit(0.5)) / F.lit(1e2)).alias("z"),
    )


def particles_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles without ids from line items: quantity, price and supplier."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_linenumber") - 1).cast("int").alias("ptype"), (F.col("l_quantity") / F.lit(51.0)).alias("x"), (F.col("l_extendedprice") / F.lit(105000.0)).alias("y"), ((F.pmod("l_suppkey", F.lit(100)) + F.lit(0.5)) / F.lit(1e2)).alias("z"),
    )


def snapshots(spark: SparkSession, n: int = 10) -> DataFrame:
    """An ordered list of snapshot names."""
    return spark.range(n).select(F.col("id").cast("int").alias("seq"), F.format_string("snap_%03d", "id").alias("root"))
