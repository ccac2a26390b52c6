"""Opening snapshots by name: Parquet, Gadget binary or HDF5; lists of snapshots; smoothing-length files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.images import ImageSink
from .files import locate, open_file
from .gadget import GadgetSource
from .hdf5 import Hdf5Source

#: Box length of a snapshot that states none.
NO_BOX = 1e6


def register(spark: SparkSession) -> None:
    """Make the data sources known to the session."""
    for source in (GadgetSource, Hdf5Source, ImageSink):
        spark.dataSource.register(source)


def _format(root: str, hdf5: bool) -> str:
    return "parquet" if root.rstrip("/").endswith(".parquet") else "skymill_hdf5" if hdf5 else "skymill_gadget"


def read_particles(spark: SparkSession, root: str, hdf5: bool = False, columns: tuple[str, ...] = (), types: list[int] | None = None) -> DataFrame:
    """Particles of a snapshot; Parquet, the format for large snapshots, is read with pushed filters and pruned columns.

    columns: those wanted, all if none are named; types: likewise, all for None. Of binary files the others are left unread.
    """
    kind = _format(root, hdf5)
    if kind == "parquet":
        df = spark.read.parquet(root)
        df = df.filter(F.col("ptype").isin(types)) if types is not None else df
        return df.select(*columns) if columns else df
    register(spark)
    if types == []:
        types = [-1]
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(kind).options(columns=",".join(columns), types=",".join(map(str, types or [])), pushdown=pushes).load(root)


def read_header(spark: SparkSession, root: str, hdf5: bool = False) -> DataFrame:
    """Headers of a snapshot's files, a row for each."""
    register(spark)
    return spark.read.format(_format(root, hdf5)).option("header", "true").load(root)


def box_size(headers: DataFrame) -> float:
    """The box length of a snapshot; NO_BOX where it states zero."""
    return headers.agg(F.max("box_size")).first()[0] or NO_BOX


def header_counts(headers: DataFrame) -> DataFrame:
    """(ptype, n): particles by type over all files."""
    return headers.select(F.posexplode("npart").alias("ptype", "n")).groupBy("ptype").agg(F.sum("n").alias("n"))


def snapshot_list(spark: SparkSession, path: str) -> DataFrame:
    """(seq, root): the lines of a list file in order, without comments and blank ones. A list has a line for each snapshot."""
    with open_file(path) as f:
        lines = [x for x in (line.split("#")[0].strip() for line in f.read().decode().splitlines()) if x]
    return spark.createDataFrame(list(enumerate(lines)), "seq int, root string")


def write_lengths(path: str, h: np.ndarray, num_ngb: int, eta: float) -> None:
    """A smoothing-length file: count, neighbours, eta, then the lengths in single precision."""
    store, name = locate(path)
    with store.open_output_stream(name) as f:
        f.write(struct.pack("<iif", len(h), num_ngb, eta) + np.asarray(h, "<f4").tobytes())


def read_lengths(path: str, n: int, num_ngb: int, eta: float) -> np.ndarray | None:
    """The lengths of a file that was written for the same settings, else None."""
    try:
        with open_file(path) as f:
            head, body = f.read(12), f.read()
    except FileNotFoundError:
        return None
    if len(head) < 12:
        return None
    count, ngb, was = struct.unpack("<iif", head)
    return np.frombuffer(body, "<f4") if (count, ngb) == (n, num_ngb) and abs(was - eta) < 1e-5 and len(body) == 4 * n else None
