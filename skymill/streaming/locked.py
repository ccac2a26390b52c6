"""Snapshots drawn as they arrive, all with the levels of the one that came first.

Two streams follow each other. The first deposits what arrives: pixels are sums, so each micro-batch adds a partition of them, and a
snapshot may come in parts. The second keeps the first snapshot's levels as its state and draws every snapshot that has new pixels.
Only a row for each arrived snapshot goes through the state, never particles or pixels. A repeated micro-batch overwrites what it wrote
before, and a new start from the same folder goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RenderConfig
from ..operators import deposit, levels, select
from ..plans.render import empty_colour, finish
from ..sinks.images import ImageSink, name_frames, render_images

PIXELS = "iy int, ix int, rho double, snapshot int, batch long"
LEVELS = "scene string, snapshot int, vmin double, vmax double, batch long"
LOCKED = "snapshot int, first int, vmin double, vmax double"


def _replaced(rows: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that rows belong to, in place of what they held."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def summed(spark: SparkSession, store: str) -> DataFrame:
    """(snapshot, iy, ix, rho) of all that has arrived."""
    return spark.read.schema(PIXELS).parquet(f"{store}/pixels").groupBy("snapshot", "iy", "ix").agg(F.sum("rho").alias("rho"))


def deposit_arrivals(stream: DataFrame, cfg: RenderConfig, box: float, store: str, scene: str = "all") -> StreamingQuery:
    """Add arriving particles (with a column snapshot; null counts as 0) to the pixels in store, and write the levels of their snapshots so far.

    A snapshot without a particle in the view has no pixels and no levels.
    """
    cfg = cfg.validated()
    centre = (cfg.xc, cfg.yc, cfg.zc)
    options = {"log_scale": cfg.log_scale, "lo": cfg.auto_pct_lo, "hi": cfg.auto_pct_hi, "most": cfg.width * cfg.height}

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        seen = select.unwrap_to_view(select.select_view(df, cfg.mask, centre, cfg.lbox, box), centre, box).withColumn("snapshot", F.coalesce("snapshot", F.lit(0)))
        pixels = deposit.cic_map(seen, cfg.width, cfg.height, centre[:2], cfg.lbox, ("snapshot",))
        kept = pixels.select(F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), "rho", F.col("snapshot").cast("int").alias("snapshot"), F.lit(number).cast("long").alias("batch"))
        _replaced(kept, f"{store}/pixels", "snapshot", "batch")
        # A row for each snapshot that arrived now. Parts of it that came before belong to it.
        arrived = spark.read.schema(PIXELS).parquet(f"{store}/pixels").filter(F.col("batch") == number).select("snapshot").distinct()
        found = levels.auto_levels(summed(spark, store).join(F.broadcast(arrived), "snapshot", "left_semi"), keys=("snapshot",), **options)
        _replaced(found.select(F.lit(scene).alias("scene"), "snapshot", "vmin", "vmax", F.lit(number).cast("long").alias("batch")), f"{store}/levels", "batch")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/checkpoint/deposit").trigger(availableNow=True).start()


def _keep_first(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a scene with the levels that hold for it: those of its earliest batch's least snapshot, once known never changed."""
    rows = pd.concat(list(tables)).sort_values(["batch", "snapshot"])
    if not state.exists:
        first = rows.iloc[0]
        state.update((int(first["snapshot"]), float(first["vmin"]), float(first["vmax"])))
    first, low, high = state.get
    yield pd.DataFrame({"snapshot": rows["snapshot"].drop_duplicates(), "first": first, "vmin": low, "vmax": high})


def draw_arrivals(spark: SparkSession, cfg: RenderConfig, store: str, output: str | None = None) -> StreamingQuery:
    """Take new levels from store, hold on to the first ones and draw the snapshots they belong to as output.NNNN.png (none: draw nothing).

    What holds for each snapshot is written below store/locked.
    """
    cfg = cfg.validated()
    arrived = spark.readStream.schema(LEVELS).parquet(f"{store}/levels")
    held = arrived.groupBy("scene").applyInPandasWithState(_keep_first, LOCKED, "first int, vmin double, vmax double", "append", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, number: int) -> None:
        # A row for each snapshot; read once, as a second reading would run the state again.
        rows = df.collect()
        if not rows:
            return
        locked = df.sparkSession.createDataFrame(rows, LOCKED)
        _replaced(locked.withColumn("batch", F.lit(number).cast("long")), f"{store}/locked", "batch")
        if output:
            fixed = replace(cfg, auto_levels=False, lock_levels=False, vmin=rows[0]["vmin"], vmax=rows[0]["vmax"])
            pixels = summed(df.sparkSession, store).join(F.broadcast(locked.select("snapshot")), "snapshot", "left_semi").withColumnRenamed("snapshot", "frame")
            df.sparkSession.dataSource.register(ImageSink)
            images = render_images(finish(pixels, fixed), cfg.width, cfg.height, empty_colour(df.sparkSession, fixed))
            name_frames(images, output).select("file", "image").write.format("skymill_images").mode("append").save()

    return held.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{store}/checkpoint/draw").trigger(availableNow=True).start()


def run_arrivals(stream: DataFrame, cfg: RenderConfig, box: float, store: str, output: str | None = None) -> DataFrame:
    """Take all that is new in the stream, draw it, and return (snapshot, first, vmin, vmax) of every snapshot so far."""
    spark = stream.sparkSession
    _finished(deposit_arrivals(stream, cfg, box, store))
    _prepare(spark, store)
    _finished(draw_arrivals(spark, cfg, store, output))
    return spark.read.schema(f"{LOCKED}, batch long").parquet(f"{store}/locked").select("snapshot", "first", "vmin", "vmax").distinct()


def _finished(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _prepare(spark: SparkSession, store: str) -> None:
    """Folders that are read even where nothing has arrived yet."""
    for name in ("levels", "locked"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
