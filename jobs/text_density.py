"""Density images of a growing text table, one for each language, kept up to date as files arrive.

Each document is a particle: its length is one axis (a decade of characters is an equal step), the share of letters in it the
other. Particles are deposited by cloud in cell, as those of a snapshot are, and shown between levels of the image's own.

A run reads the files that no earlier run read (a file stream with a checkpoint), adds their particles' deposits to
`cells`, one partition for each micro-batch, and then draws anew the languages that have newer cells than their image. So the
work of a run grows with what is new, and what it leaves equals one run over all files.

A run that dies is run again: a repeated micro-batch writes its own partition once more, and an image that was not written is
still older than its cells. A text without language counts as `none`; a null text is an empty one, at the origin. Texts
beyond `decades` lie on the image's edge. Files must not change once they are there.

Output: `images` partitioned by lang (iy, ix, rho, shade, upto), `cells`, `checkpoint`; with `pictures` also PNG files in `pictures`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, exists, log, logged, settings
from skymill.functions.colour import byte, normalise
from skymill.operators.deposit import cic_map
from skymill.operators.levels import auto_levels
from skymill.sinks.images import ImageSink, render_images

DEFAULTS = {"text": "text", "lang": "lang", "width": 64, "height": 64, "decades": 6.0, "low": 0.1, "high": 1.0, "files_per_batch": 1000, "pictures": False}
#: Letters one by one as far as Latin-1 goes, which Java looks up in a table; ranges are compared one after the other.
LETTERS = "".join(c for c in map(chr, range(0x100)) if (c.isalpha() and c.isascii()) or (c >= "À" and c not in "×÷")) + "Ā-ɏ"
CELLS = "batch long, lang string, iy int, ix int, rho double"
IMAGES = "lang string, iy int, ix int, rho double, shade int, upto long"


def as_particles(docs: DataFrame, s: dict) -> DataFrame:
    """(lang, x, y) of every document, in a unit square whose edges lie in the middle of the outermost pixels, so that no document is cut off."""
    t: Column = F.coalesce(F.col(f"`{s['text']}`"), F.lit(""))
    lang = F.coalesce(F.nullif(F.col(f"`{s['lang']}`").cast("string"), F.lit("")), F.lit("none"))
    # Rows of a generator, since filters on x and y would otherwise go below and count each text's letters once more.
    counts = F.struct(F.length(t).alias("n"), (F.length(t) - F.length(F.regexp_replace(t, f"[{LETTERS}]+", ""))).alias("letters"))
    named = docs.select(lang.alias("lang"), F.inline(F.array(counts)))
    n = F.col("n")
    x = F.least(F.log10((n + 1).cast("double")) / s["decades"], F.lit(1.0))
    y = F.when(n > 0, F.col("letters") / n).otherwise(0.0)
    inner = [p * (1 - 1 / k) + 0.5 / k for p, k in ((x, s["width"]), (y, s["height"]))]
    return named.select("lang", inner[0].alias("x"), inner[1].alias("y"))


def take_new(spark: SparkSession, source: str, output: str, s: dict) -> None:
    """Deposit the documents of all files that the checkpoint does not know."""
    # As a pattern of just this path, since a stream takes a plain path for a folder.
    pattern = source if re.search(r"[*?\[{]", source) else f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"
    wanted = spark.read.parquet(source).select(f"`{s['text']}`", f"`{s['lang']}`").schema

    def deposit(batch: DataFrame, number: int) -> None:
        cells = cic_map(as_particles(batch, s), s["width"], s["height"], (0.5, 0.5), 1.0, ("lang",))
        rows = cells.select(F.lit(number).cast("long").alias("batch"), "lang", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), "rho")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/cells")
        logged(spark.read.schema(CELLS).parquet(f"{output}/cells").filter(F.col("batch") == number), f"wrote cells of batch {number}")

    stream = spark.readStream.schema(wanted).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(pattern)
    query = stream.writeStream.foreachBatch(deposit).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %d new documents of %s in %d batches", sum(p["numInputRows"] for p in query.recentProgress), source, sum(p["numInputRows"] > 0 for p in query.recentProgress))


def draw(spark: SparkSession, output: str, s: dict) -> None:
    """Draw the languages whose cells are newer than their image."""
    cells = spark.read.schema(CELLS).parquet(f"{output}/cells")
    newest = cells.groupBy("lang").agg(F.max("batch").alias("upto"))
    if exists(spark, f"{output}/images"):
        drawn = spark.read.schema(IMAGES).parquet(f"{output}/images").groupBy("lang").agg(F.max("upto").alias("drawn"))
        newest = newest.join(drawn, "lang", "left").filter(F.col("drawn").isNull() | (F.col("drawn") < F.col("upto"))).drop("drawn")
    # A row for each language. What is drawn is fixed before images are written over.
    languages = sorted(map(tuple, newest.collect()))
    if not languages:
        log.info("all images are up to date")
        return
    todo = spark.createDataFrame(languages, "lang string, upto long")
    pixels = cells.join(todo, "lang").filter(F.col("batch") <= F.col("upto")).groupBy("lang", "upto", "iy", "ix").agg(F.round(F.sum("rho"), 6).alias("rho")).filter("rho > 0")
    levels = auto_levels(pixels, True, s["low"], s["high"], ("lang",), s["width"] * s["height"]).select("lang", "vmin", "vmax")
    shown = pixels.join(levels, "lang").select("lang", "iy", "ix", "rho", byte(normalise(F.col("rho"), F.col("vmin"), F.col("vmax"), True)).alias("shade"), "upto")
    shown.repartition("lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(f"{output}/images")
    now = spark.read.schema(IMAGES).parquet(f"{output}/images").join(todo.select("lang"), "lang", "left_semi")
    logged(now, f"wrote images of {len(languages)} languages")
    if s["pictures"]:
        spark.dataSource.register(ImageSink)
        order = spark.createDataFrame([(lang, i) for i, (lang, _) in enumerate(languages)], "lang string, frame int")
        gray = now.join(order, "lang").select("frame", "iy", "ix", *[F.col("shade").alias(c) for c in "rgb"], F.lit(255).alias("a"))
        files = render_images(gray, s["width"], s["height"], channels="rgb").join(order, "frame").select(F.concat(F.lit(f"{output}/pictures/"), F.col("lang"), F.lit(".png")).alias("file"), "image")
        files.write.format("skymill_images").mode("append").save()


def run(spark: SparkSession, source: str, output: str, given: dict | None = None) -> DataFrame:
    """Take what is new in the table at source, bring the images below output up to date and return them (lang, iy, ix, rho, shade, upto)."""
    s = settings(DEFAULTS, given or {})
    take_new(spark, source, output, s)
    if exists(spark, f"{output}/cells"):
        draw(spark, output, s)
    if not exists(spark, f"{output}/images"):
        log.info("nothing to draw")
        return spark.createDataFrame([], IMAGES)
    return spark.read.schema(IMAGES).parquet(f"{output}/images").select("lang", "iy", "ix", "rho", "shade", "upto")


if __name__ == "__main__":
    command_line(__doc__, run)
