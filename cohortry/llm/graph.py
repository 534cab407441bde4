"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import discard, measured


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is the smallest node that can be reached.

    Every step is two aggregates by key and two joins, and its edges are written to the shared folder, so neither
    lineage nor the driver holds the graph; their number and checksum are taken as they are written. Steps end when the edges stay as they are; their number grows with the
    logarithm of the longest chain. Nulls and self-loops are left out; an empty table gives no node.
    """
    now, state = _held(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), 0)
    step = 0
    while state[0]:
        step += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("k").alias("u"), F.col("m").alias("v"))
        )
        before = now
        now, new = _held(small, step)
        discard(before)
        if new == state:
            break
        state = new
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _held(edges: DataFrame, step: int) -> tuple[DataFrame, tuple[int, int, int]]:
    h = F.xxhash64("u", "v")
    parts = {"low": h.bitwiseAND(F.lit(0xFFFFFFFF)), "high": F.shiftright(h, 32)}
    sums = {n: F.coalesce(F.sum(x), F.lit(0)) for n, x in parts.items()}
    out, found = measured(edges.distinct(), f"cc-{step}", n=F.count(F.lit(1)), **sums)
    return out, (found["n"], found["low"], found["high"])
