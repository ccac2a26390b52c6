"""The snapshots of a sequence as one table bucketed by id, so that matching them moves no rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import AXES
from ..staging import staged


def write_bucketed(snapshots: list[DataFrame], path: str, box: float, buckets: int | None = None) -> None:
    """Write snapshots in their order to a new folder: `named`, bucketed by id, `rest` and `about`.

    named: one row for each id and snapshot, of several the one with the least hash, as one_per_id has it. rest: all other
    rows, that is repeated ids and rows without one; they keep their places in `sources.bucketed`, but have to be matched
    by a join, however many they are. Row numbers tell equal rows apart, so the rows are written once before.
    buckets: files, as many as tasks should match (None: as many as a shuffle has partitions); other columns are not kept.
    """
    buckets = buckets or int(snapshots[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reduce(DataFrame.unionByName, [s.select(F.col("id").cast("long").alias("id"), "ptype", *AXES, F.lit(i).alias("place")) for i, s in enumerate(snapshots)])
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()))
    least = rows.filter("id IS NOT NULL").groupBy("id", "place").agg(F.min_by("__row", F.xxhash64(*AXES, "ptype")).alias("__row")).select("__row")
    named, rest = (rows.join(least, "__row", kind).drop("__row") for kind in ("left_semi", "left_anti"))
    # Saving as a table is how Spark writes buckets; the name is dropped, the files stay.
    name = f"skymill_{uuid.uuid4().hex}"
    named.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id", "place").option("path", f"{path}/named").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")
    rest.write.parquet(f"{path}/rest")
    rows.sparkSession.createDataFrame([(buckets, len(snapshots), float(box))], "buckets int, places int, box double").coalesce(1).write.parquet(f"{path}/about")
