"""Reading the snapshots of a sequence from a table bucketed by id (`sinks.bucketed`)."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "id BIGINT, ptype INT, x DOUBLE, y DOUBLE, z DOUBLE, place INT"


class Bucketed(NamedTuple):
    """Snapshots of a sequence: rows with one for each id and snapshot, other rows (None: there are none), snapshots, box length."""

    named: DataFrame
    rest: DataFrame | None
    places: int
    box: float


def open_bucketed(spark: SparkSession, path: str) -> Bucketed:
    """The snapshots in a folder that write_bucketed wrote, in this session or before.

    The buckets are made known to Spark by a table of a new name over that folder.
    """
    about = spark.read.parquet(f"{path}/about").first()  # one row
    name, place = f"skymill_{uuid.uuid4().hex}", f"{path}/named".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (id) SORTED BY (id, place) INTO {about['buckets']} BUCKETS LOCATION '{place}'")
    rest = spark.read.schema(COLUMNS).parquet(f"{path}/rest")
    return Bucketed(spark.table(name), rest if rest.take(1) else None, about["places"], about["box"])
