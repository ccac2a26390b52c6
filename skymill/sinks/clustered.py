"""Particles as Parquet, ordered along a space-filling curve, so that a view reads only the row groups it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import morton
from ..schema import AXES

#: Bytes of a row group before compression; small next to a file, as a view skips whole row groups.
GROUP_BYTES = 8 << 20


def write_clustered(df: DataFrame, path: str, box: float, files: int | None = None, by: tuple[str, ...] = ("ptype",), group_bytes: int = GROUP_BYTES, mode: str = "errorifexists") -> None:
    """Write the rows partitioned by columns and ordered along the curve; all columns stay as they are.

    Files are ranges of the curve of like sizes, cut from a sample, so a dense region gets more of them; rows of one place are told apart
    by a hash of all their columns, so many of them do not meet in one task. Rows without a position come first.
    """
    taken = {c.lower() for c in df.columns}
    names = [n for n in ("__curve", "__curve_tie", *(f"__curve{i}" for i in range(len(taken) + 2))) if n not in taken][:2]
    place, tie = names
    keyed = df.withColumns({place: morton(tuple(F.col(a) for a in AXES), 0.0, box), tie: F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    order = [*by, place, tie]
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(place, tie)
    dealt.write.partitionBy(*by).option("parquet.block.size", str(group_bytes)).option("parquet.page.size", str(max(1 << 12, group_bytes // 16))).mode(mode).parquet(path)
