"""Connected components of link tables, without collecting links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, stage_table


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A subset of the links that joins what all of them join."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, kept = list(range(len(names))), []
    for k, (i, j) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True)):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[j] = i
            kept.append(k)
    return a[kept], b[kept]


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of the links with the least node reachable.

    Alternating large-star and small-star steps over the links; each round is written to the shared folder, and the
    number of rounds grows with the logarithm of the longest path. A hub's links are pre-aggregated by minimum.
    """
    edges = stage_table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each node's larger neighbours point to the least of it and its neighbours.
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = stage_table(least.select("u", F.least("u", "m").alias("m"), "n"), "least")
        larger = join_by_key(both.filter("v > u"), least, "u", "n", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage_table(larger.filter("u <> v").distinct(), "large")
        # Small star: each node and its smaller neighbours point to the least of those.
        least = stage_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        moved = join_by_key(large, least, "u", "n", "inner")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stage_table(small.filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_ids(classes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """(node, component_id, n) for staged classes (node, first_id, n): the least first_id that links reach, its own included."""
    roots = stage_table(connected(links).withColumnRenamed("node", "__node"), "roots")
    of_class = classes.join(roots, classes[node] == roots["__node"], "left").select(node, "first_id", "n", F.coalesce("root", node).alias("root"))
    of_class = stage_table(of_class, "classes")
    leader = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return join_by_key(of_class, stage_table(leader, "leaders"), "root", "members", "inner").select(node, "component_id", "n")
