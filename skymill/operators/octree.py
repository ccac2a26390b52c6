"""Octrees, or binary trees over one axis, as tables of nodes: cells halved along every axis while they hold more than a bucket.

A node is named by its path, a digit for each level below the root: bit i is set if the upper half of axis i was taken; the
middle belongs to the lower half. Counts and means are summed up from the finest cells, so particles are shuffled once, as
partial sums; walks are joins of queries with the nodes of one level after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AXES
from ..staging import staged
from .tree import _ranked

BUCKET, DEPTH = 8, 10


def _cells(points: DataFrame, axes: tuple[str, ...], depth: int) -> DataFrame:
    """points with the box of all of them (l, s: low ends and lengths) and their finest cells c."""
    ends = [x for a in axes for x in (F.min(a).alias(f"l{a}"), (F.max(a) - F.min(a)).alias(f"s{a}"))]
    placed = points.crossJoin(F.broadcast(points.agg(*ends)))  # one row
    return placed.withColumns({f"c{a}": F.greatest(F.lit(0), F.ceil(F.when(F.col(f"s{a}") > 0, (F.col(a) - F.col(f"l{a}")) / F.col(f"s{a}")).otherwise(0.0) * 2**depth).cast("long") - 1) for a in axes})


def _path(axes: tuple[str, ...], level: int) -> Column:
    """The path of the cell c of a level."""
    digits = [sum((F.shiftleft(F.shiftright(f"c{a}", level - i).bitwiseAND(1), k) for k, a in enumerate(axes)), F.lit(0)).cast("string") for i in range(1, level + 1)]
    return F.concat(F.lit(""), *digits)


def nodes(points: DataFrame, axes: tuple[str, ...] = AXES, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(path, level, split, n, mean_a, low_a, high_a for each axis a): all nodes with particles, staged.

    A node is split if it holds more than bucket particles; at the given depth none is, however many lie in one place.
    """
    box = [f"{s}{a}" for a in axes for s in "ls"]
    cells = _cells(points, axes, depth).groupBy(*[f"c{a}" for a in axes]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"t{a}") for a in axes], *[F.first(b).alias(b) for b in box])
    finest = staged(cells)
    levels = [finest]
    for _ in range(depth):
        up = levels[0].withColumns({f"c{a}": F.shiftright(f"c{a}", 1) for a in axes})
        levels.insert(0, up.groupBy(*[f"c{a}" for a in axes]).agg(F.sum("n").alias("n"), *[F.sum(f"t{a}").alias(f"t{a}") for a in axes], *[F.first(b).alias(b) for b in box]))
    out = []
    for level, here in enumerate(levels):
        if level:
            above = levels[level - 1].filter(F.col("n") > bucket).select(*[F.col(f"c{a}").alias(f"p{a}") for a in axes])
            here = here.join(above, reduce(lambda x, y: x & y, [F.shiftright(f"c{a}", 1) == F.col(f"p{a}") for a in axes]), "left_semi")
        size = {a: F.col(f"s{a}") / 2**level for a in axes}
        ends = [x for a in axes for x in ((F.col(f"l{a}") + F.col(f"c{a}") * size[a]).alias(f"low_{a}"), (F.col(f"l{a}") + (F.col(f"c{a}") + 1) * size[a]).alias(f"high_{a}"))]
        split = (F.col("n") > bucket) if level < depth else F.lit(False)
        out.append(here.select(_path(axes, level).alias("path"), F.lit(level).alias("level"), split.alias("split"), "n", *[(F.col(f"t{a}") / F.col("n")).alias(f"mean_{a}") for a in axes], *ends))
    return staged(reduce(DataFrame.unionByName, out))


def numbered(tree: DataFrame) -> DataFrame:
    """Adds index, from 1 with a node before its children, and place, from 0 with it between its first child's nodes and the others'.

    Both are orders of the paths: a prefix comes first, or as if a digit between 0 and 1 followed it. Numbered by range shuffles.
    """
    between = F.concat(F.translate("path", "01234567", "02345678"), F.lit("1"))
    out = tree
    for name, key, first in (("index", F.col("path"), 1), ("place", between, 0)):
        keyed = out.select("*", F.lit(0).alias("__one"), key.alias("__key"), F.lit(0).alias("id"))
        out = _ranked(keyed, "__one", "__key").withColumn(name, F.col("rn") - 1 + first).drop("__one", "__key", "id", "rn")
    return out


def node_of(queries: DataFrame, tree: DataFrame, axes: tuple[str, ...] = AXES, depth: int = DEPTH) -> DataFrame:
    """(id, path, n): the deepest node whose cell holds each query; the root for queries beyond it.

    Joined with each query's cells on all levels, by path; a query outside the box counts as at its nearest edge.
    """
    box = tree.filter("level = 0").select(*[x for a in axes for x in (F.col(f"low_{a}").alias(f"l{a}"), (F.col(f"high_{a}") - F.col(f"low_{a}")).alias(f"s{a}"))])
    placed = queries.select("id", *axes).crossJoin(F.broadcast(box))  # one row
    last = 2**depth - 1
    cell = {f"c{a}": F.least(F.lit(last), F.greatest(F.lit(0), F.ceil(F.when(F.col(f"s{a}") > 0, (F.col(a) - F.col(f"l{a}")) / F.col(f"s{a}")).otherwise(0.0) * 2**depth).cast("long") - 1)) for a in axes}
    whole = placed.withColumns(cell).select("id", _path(axes, depth).alias("whole"))
    every = whole.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda n: F.substr("whole", F.lit(1), n))).alias("path"))
    found = every.join(tree.select("path", "level", "n"), "path").groupBy("id").agg(F.max(F.struct("level", "path", "n")).alias("m"))
    return found.select("id", "m.path", "m.n")


def leaves_near(queries: DataFrame, tree: DataFrame, search: float, axes: tuple[str, ...] = AXES, depth: int = DEPTH) -> DataFrame:
    """(id, n_leaves, n_members): leaves whose cells a box of so much on either side of each query overlaps, and their particles.

    Each level's overlapped nodes that are split lead to the next. Queries near no leaf have zeros.
    """
    overlap = reduce(lambda x, y: x & y, [(F.col(a) - search < F.col(f"high_{a}")) & (F.col(a) + search > F.col(f"low_{a}")) for a in axes])
    digits = F.transform(F.sequence(F.lit(0), F.lit(2 ** len(axes) - 1)), lambda k: F.concat("path", k.cast("string")))
    walk, seen = queries.select("id", *axes, F.lit("").alias("path")), []
    for level in range(depth + 1):
        here = walk.join(tree.filter(F.col("level") == level).drop("level"), "path").filter(overlap)
        seen.append(here.filter(~F.col("split")).select("id", "n"))
        walk = here.filter("split").select("id", *axes, digits.alias("paths")).select("id", *axes, F.explode("paths").alias("path"))
    found = reduce(DataFrame.unionByName, seen).groupBy("id").agg(F.count(F.lit(1)).alias("n_leaves"), F.sum("n").alias("n_members"))
    return queries.select("id").join(found, "id", "left").select("id", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("n_members", F.lit(0)).alias("n_members"))
