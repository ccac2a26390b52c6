"""Helpers that the training-data operators share: shared storage, Arrow plumbing and skew-safe joins."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word cache may hold before it is emptied (about 40 MB of short words).
CACHE_WORDS = 200_000
#: Words longer than this are never cached.
CACHE_CHARS = 48
#: Arrow batches are cut into slices of at most so many rows, so that Python lists stay small.
SLICE_ROWS = 512
#: And of at most about so many bytes, but for a single longer text.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    """For local sessions without the setting."""
    return "file://" + tempfile.mkdtemp(prefix="skymill-")


def shared_root(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, as a full URI; deleted when the application ends.

    Where the setting is missing, a temporary folder takes its place if driver and executors are one process; on a cluster
    that would be every machine's own, so there the setting must be made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or _own_folder()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/skymill-{uuid.uuid4().hex}")
    fs = path.getFileSystem(conf)
    path = fs.makeQualified(path)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def stage_table(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a second run of what came before. narrow: the rows are
    few bytes next to what they were made from, so they are gathered into files of a fair size instead of one for each task.
    """
    path = f"{shared_root(df.sparkSession)}/{name}"
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STATE: list = []


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks, built when first asked for. Only the last key's is held, so that
    the caches of a pipeline's earlier operators do not add up."""
    if not _STATE or _STATE[0] != key:
        _STATE.clear()
        gc.collect()
        _STATE[:] = [key, make()]
    return _STATE[1]


def release_state() -> None:
    """Let go of what the worker keeps, and give freed memory back: for tasks that need none of it."""
    if _STATE:
        _STATE.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def clear_name(columns: list[str], name: str) -> str:
    """A name that begins no column's, in any case."""
    name = f"__{name}"
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into zero-copy slices of at most so many rows and about so many bytes of text; empty ones are left out."""
    for batch in batches:
        weight = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(weight), 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(at + rows, max(at + 1, most), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, keeps: bool = False) -> DataFrame:
    """Apply fn to Arrow slices of the named columns; no shuffle, and only those columns are scanned. keeps: fn uses worker_state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release_state()
        for part in slices(batches):
            yield fn(part)
        pa.default_memory_pool().release_unused()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[list[str]], list[bool]], keeps: bool = False) -> DataFrame:
    """The rows, with all columns, whose text passes; no shuffle. keeps: keep uses worker_state."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release_state()
        for part in slices(batches):
            yield part.filter(pa.array(keep(text_list(part.column(at))), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


def text_list(column: pa.Array) -> list[str]:
    """Python strings of a text column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def join_by_key(rows: DataFrame, stats: DataFrame, key: str, n_rows: str, how: str = "left", hot_keys: int = 200) -> DataFrame:
    """Join rows with one row of stats for each key, where a key may hold a third of all rows.

    Keys with more than 1/hot_keys of the rows number fewer than hot_keys, so they are broadcast whatever
    the input's size; all others meet in an ordinary shuffle join. Both inputs are read twice: stage them.
    A null key joins nothing (kept by a left join).
    """
    total = stats.agg(F.sum(n_rows)).first()[0] or 0
    least = max(1000, total // hot_keys)
    hot = F.broadcast(stats.filter(F.col(n_rows) > least))
    cold = stats.filter(F.col(n_rows) <= least)
    many = rows.join(hot, key, "inner")
    few = rows.join(F.broadcast(stats.filter(F.col(n_rows) > least).select(key)), key, "left_anti").join(cold, key, how)
    return many.unionByName(few)
