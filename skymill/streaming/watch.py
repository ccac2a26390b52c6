"""Rendering snapshots as they arrive, and running counts over a stream of particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import RenderConfig
from ..operators import deposit, select
from ..plans.render import empty_colour, finish
from ..sinks.images import name_frames, render_images


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of particle files (Parquet) in a folder, with the column snapshot: the number in each file's name."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn("snapshot", F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*\.parquet$", 1).try_cast("int"))


def render_arrivals(stream: DataFrame, cfg: RenderConfig, box: float, output: str, checkpoint: str) -> StreamingQuery:
    """Render each arriving snapshot to output.NNNN.png with fixed levels; a batch that is repeated writes the same files."""
    cfg = cfg.validated()
    centre = (cfg.xc, cfg.yc, cfg.zc)

    def batch(df: DataFrame, _: int) -> None:
        seen = select.unwrap_to_view(select.select_view(df, cfg.mask, centre, cfg.lbox, box), centre, box).withColumn("frame", F.coalesce("snapshot", F.lit(0)))
        pixels = deposit.cic_map(seen, cfg.width, cfg.height, centre[:2], cfg.lbox, ("frame",))
        images = render_images(finish(pixels, cfg), cfg.width, cfg.height, empty_colour(df.sparkSession, cfg))
        name_frames(images, output).select("file", "image").write.format("skymill_images").mode("append").save()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_density(stream: DataFrame, cfg: RenderConfig) -> DataFrame:
    """A streaming aggregation: particles of each type in each coarse cell of the view so far."""
    cell = [F.floor((F.col(a) - c + cfg.lbox / 2) * 16 / cfg.lbox).cast("int").alias(f"c{a}") for a, c in (("x", cfg.xc), ("y", cfg.yc))]
    return stream.filter(select.type_filter(cfg.mask)).groupBy("ptype", *cell).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by type and time window, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "ptype").agg(F.count(F.lit(1)).alias("n"))
