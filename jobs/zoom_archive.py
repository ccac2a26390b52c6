"""An archive of particles ordered in space, and a zoom into it that reads only what its view touches.

The particles of a table are written once as Parquet, partitioned by type and ordered along a space-filling curve (`archive`).
All frames of a zoom are then one job over the row groups that the widest view touches: type and view are filtered in the
scan, also where the view crosses the box's edge. Every frame is deposited by cloud in cell and shown between the levels of the
first one.

Both outputs are written over as a whole, so a run that died is run again, and a second run leaves the same. Rows
without a type or a position are counted and left out. Positions lie in a periodic box of `box`.

Output: `archive` partitioned by ptype, `frames` partitioned by frame (iy, ix, rho, shade); with `pictures` also PNG files in `pictures`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, logged, settings
from skymill.config import RenderConfig
from skymill.functions.colour import byte, normalise
from skymill.operators.deposit import cic_map
from skymill.operators.frames import frames_table, with_frames
from skymill.operators.levels import locked_levels
from skymill.operators.select import select_view, unwrap_to_view
from skymill.schema import AXES
from skymill.sinks.clustered import write_clustered
from skymill.sinks.images import ImageSink, name_frames, render_images

#: Columns of the table, as SQL; by default those that make particles of line items.
DEFAULTS = {
    "ptype": "cast(l_linenumber - 1 AS int)", "x": "l_quantity / 51D", "y": "l_extendedprice / 105000D", "z": "(pmod(l_suppkey, 100) + 0.5D) / 100D",
    "box": 1.0, "files": 32, "types": [], "centre": [0.05, 0.5, 0.95], "lbox": 0.8, "zoom": 4, "zoom_factor": 0.5, "width": 64, "height": 64, "low": 0.1, "high": 1.0, "pictures": False,
}
ARCHIVE = "ptype int, x double, y double, z double"
FRAMES = "frame int, iy int, ix int, rho double, shade int"


def archive(spark: SparkSession, source: str, output: str, s: dict) -> None:
    """Write the table's particles along the curve."""
    raw = spark.read.parquet(source).select(F.expr(s["ptype"]).cast("int").alias("ptype"), *[F.expr(s[a]).cast("double").alias(a) for a in AXES])
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ("ptype", *AXES)) + "".join(f" AND NOT isnan({a})" for a in AXES)
    log.info("read %d rows of %s, %d without type or position left out", raw.count(), source, raw.filter(f"NOT ({whole})").count())
    write_clustered(raw.filter(whole), f"{output}/archive", s["box"], s["files"], mode="overwrite")
    logged(spark.read.schema(ARCHIVE).parquet(f"{output}/archive"), f"wrote the archive of {source}")


def zoom(spark: SparkSession, output: str, s: dict) -> DataFrame:
    """All frames' pixels (frame, iy, ix, rho, shade), from the archive."""
    centre = tuple(map(float, s["centre"]))
    mask = sum(1 << t for t in s["types"]) if s["types"] else -1
    cfg = RenderConfig(lbox=s["lbox"], zoom=s["zoom"], zoom_factor=s["zoom_factor"], xc=centre[0], yc=centre[1], zc=centre[2])
    seen = select_view(spark.read.schema(ARCHIVE).parquet(f"{output}/archive"), mask, centre, s["lbox"], s["box"])
    frames = with_frames(unwrap_to_view(seen, centre, s["box"]), frames_table(spark, cfg))
    pixels = cic_map(frames, s["width"], s["height"], centre[:2], F.col("lbox"), ("frame",)).select("frame", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), F.round("rho", 4).alias("rho")).filter("rho > 0")
    levels = locked_levels(pixels, log_scale=True, lo=s["low"], hi=s["high"], most=s["width"] * s["height"])
    shade = byte(normalise(F.col("rho"), F.col("vmin"), F.col("vmax"), True))
    return pixels.join(levels, "frame").select("frame", "iy", "ix", "rho", shade.alias("shade"))


def run(spark: SparkSession, source: str, output: str, given: dict | None = None) -> DataFrame:
    """Archive the table at source below output, draw the zoom from it and return its frames (frame, iy, ix, rho, shade)."""
    s = settings(DEFAULTS, given or {})
    archive(spark, source, output, s)
    zoom(spark, output, s).repartition("frame").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("frame").parquet(f"{output}/frames")
    drawn = spark.read.schema(FRAMES).parquet(f"{output}/frames").select("frame", "iy", "ix", "rho", "shade")
    logged(drawn, "wrote pixels of the zoom")
    if s["pictures"]:
        spark.dataSource.register(ImageSink)
        gray = drawn.select("frame", "iy", "ix", *[F.col("shade").alias(c) for c in "rgb"], F.lit(255).alias("a"))
        name_frames(render_images(gray, s["width"], s["height"], channels="rgb"), f"{output}/pictures/zoom").select("file", "image").write.format("skymill_images").mode("append").save()
    return drawn


if __name__ == "__main__":
    command_line(__doc__, run)
