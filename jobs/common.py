"""What the jobs share: settings from a small JSON file, a command line, folders, and counts of what was written."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skymill.staging import prepare

log = logging.getLogger("jobs")


def settings(defaults: dict, given: dict) -> dict:
    """The defaults with what is given; ValueError for a name or kind that no default has."""
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"unknown setting {name!r}; known are {', '.join(sorted(defaults))}")
        kind = type(defaults[name])
        if not (isinstance(value, kind) or (kind is float and isinstance(value, int))) or (isinstance(value, bool) and kind is not bool):
            raise ValueError(f"setting {name!r} is a {kind.__name__}, not {value!r}")
    return {**defaults, **given}


def command_line(about: str, run: Callable[..., DataFrame], argv: list[str] | None = None) -> None:
    """Read paths and settings, create a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input", required=True, help="table to read: a Parquet file or folder, any path that Spark reads")
    parser.add_argument("--output", required=True, help="folder to write to; run again on the same one to go on")
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="settings that override the file's; values are JSON")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    given = json.loads(Path(args.config).read_text()) if args.config else {}
    given |= {name: json.loads(value) for name, _, value in (s.partition("=") for s in args.set)}
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, args.input, args.output, given)
    finally:
        spark.stop()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the session's checkpoint folder that nothing else uses; it is left there."""
    prepare(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def logged(written: DataFrame, what: str) -> int:
    """Log and return how many rows lie where a write has written; Parquet's footers tell."""
    n = written.count()
    log.info("%s: %d rows", what, n)
    return n
