"""Shares over bins: means, spreading a missing part, intervals, draws, histograms and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.blend import blend


def mean_shares(df: DataFrame, group: Sequence[str], bin_: str, share: str) -> DataFrame:
    """Unweighted mean share by group and bin."""
    return df.groupBy(*group, bin_).agg(F.avg(share).alias("mean_share"))


def spread_missing(df: DataFrame, group: Sequence[str], bin_: str, known: str, mean: str) -> DataFrame:
    """Spreads what is missing to 1 over a group's bins, as near as can be to ``mean - known`` and never negative.

    This is the projection of d = mean - known on the simplex of size u = 1 - sum(known): with d in falling order and
    t_k = (d_1 + ... + d_k - u) / k, the level is t at the largest k with d_k > t_k, and a bin gets max(d - level, 0).
    Adds ``added`` and ``adjusted``.
    """
    whole = Window.partitionBy(*group)
    order = whole.orderBy(F.col("_d").desc(), F.col(bin_))
    df = df.withColumn("_d", F.col(mean) - F.col(known)).withColumn("_u", 1 - F.sum(known).over(whole))
    df = df.withColumn("_k", F.row_number().over(order)).withColumn("_cs", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_t", (F.col("_cs") - F.col("_u")) / F.col("_k"))
    level = F.max(F.when(F.col("_d") > F.col("_t"), F.struct("_k", "_t"))).over(whole)["_t"]
    df = df.withColumn("added", F.greatest(F.col("_d") - level, F.lit(0.0)))
    return df.withColumn("adjusted", F.col(known) + F.col("added")).drop("_d", "_u", "_k", "_cs", "_t")


def bad_sums(df: DataFrame, group: Sequence[str], share: str, tolerance: float = 1e-8) -> DataFrame:
    """Groups whose shares don't sum to 1."""
    total = df.groupBy(*group).agg(F.sum(share).alias("total"), F.count("*").alias("n"))
    return total.filter(F.abs(F.col("total") - 1) > tolerance)


def different_lengths(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Groups that have not as many rows in one table as in the other."""
    x = left.groupBy(group).agg(F.count("*").alias("n_left"))
    y = right.groupBy(group).agg(F.count("*").alias("n_right"))
    both = x.join(y, group, "full_outer").na.fill(0, ["n_left", "n_right"])
    return both.filter("n_left <> n_right")


def normalised(df: DataFrame, group: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Values over their group's sum; a sum of 0 gives null."""
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*group))))


def intervals(df: DataFrame, group: Sequence[str], order: str, prob: str) -> DataFrame:
    """Adds [lo, hi) of each outcome; the last ``hi`` of a group is 1."""
    line = Window.partitionBy(*group).orderBy(order)
    running = F.sum(prob).over(line.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_hi", running).withColumn("lo", F.coalesce(F.lag("_hi").over(line), F.lit(0.0)))
    last = F.lead(F.lit(1)).over(line).isNull()
    return df.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.col("_hi"))).drop("_hi")


def draw(rows: DataFrame, outcomes: DataFrame, u: str, keys: Sequence[str] = ()) -> DataFrame:
    """Gives each row the outcome whose interval holds its ``u``; ``outcomes`` has lo, hi and the keys.

    Without keys the outcomes are one distribution, which is broadcast for a nested-loop join; with keys they grow with
    the groups, so Spark chooses the join by their size.
    """
    o = outcomes.select(*[F.col(c).alias(f"_o_{c}") if c in keys else F.col(c) for c in outcomes.columns])
    fits = (F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))
    for k in keys:
        fits = fits & (F.col(k) == F.col(f"_o_{k}"))
    return rows.join(o if keys else F.broadcast(o), fits).drop("lo", "hi", *[f"_o_{k}" for k in keys])


def alias_tables(outcomes: DataFrame, group: Sequence[str], outcome: str, weight: str) -> DataFrame:
    """One row per group: ``total`` (of the weights, which are whole numbers) and ``cells``, an alias table to draw from in
    constant time: as many cells as outcomes with a weight, each with ``own``, ``keep`` (of ``total``) and ``alias``.

    A cell has room for ``total``, and an outcome brings its weight times the number of cells. Light outcomes lack a
    deficit, heavy ones have a surplus. With both summed in order, a light cell is filled by the first heavy outcome whose
    surpluses reach the deficits before it, and a heavy one gives its room beyond its own surpluses to the next heavy
    outcome. So what a sweep over both lists would do follows from running sums, in windows over the group. Sums are
    whole numbers, so each outcome gets exactly its share.
    """
    whole = Window.partitionBy(*group)
    df = outcomes.filter(F.col(weight) > 0).select(*group, F.col(outcome).alias("own"), F.col(weight).cast("long").alias("_w"))
    df = df.withColumn("total", F.sum("_w").over(whole)).withColumn("_have", F.col("_w") * F.count("*").over(whole))
    df = df.withColumn("_heavy", F.col("_have") >= F.col("total")).withColumn("_off", F.abs(F.col("_have") - F.col("total")))
    of_kind = Window.partitionBy(*group, "_heavy").orderBy("own")
    df = df.withColumn("_to", F.sum("_off").over(of_kind.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_next", F.lead("own").over(of_kind)).withColumn("_from", F.when(F.col("_heavy"), F.col("_to")).otherwise(F.col("_to") - F.col("_off")))
    back = lambda key: whole.orderBy(F.desc(key), F.desc("_heavy"), F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_filler", F.last(F.when(F.col("_heavy"), F.col("own")), True).over(back("_from")))
    df = df.withColumn("_short", F.last(F.when(~F.col("_heavy"), F.col("_to")), True).over(back("_to")))
    keep = F.when(~F.col("_heavy"), F.col("_have")).otherwise(F.col("total") - F.coalesce(F.col("_short") - F.col("_to"), F.lit(0)))
    alias = F.when(~F.col("_heavy"), F.col("_filler")).when(F.col("_short").isNotNull(), F.col("_next"))
    cell = F.struct("own", keep.alias("keep"), alias.alias("alias"))
    return df.groupBy(*group, "total").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def draw_by_alias(rows: DataFrame, tables: DataFrame, u: str, keys: Sequence[str], out: str) -> DataFrame:
    """Gives each row the outcome that its ``u`` in [0, 1) draws from its group's alias table; rows without a table are
    left out. One join by equal keys and one look at one cell, whatever the number of outcomes."""
    t = tables.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "total", "cells")
    same = [F.col(k) == F.col(f"_t_{k}") for k in keys]
    at = F.col(u) * F.size("cells")
    cell = F.get("cells", F.floor(at).cast("int"))
    drawn = F.when((at - F.floor(at)) * F.col("total") < cell["keep"], cell["own"]).otherwise(cell["alias"])
    return rows.join(t, same).withColumn(out, drawn).drop("total", "cells", *[f"_t_{k}" for k in keys])


def single_ages(bins: DataFrame, lo: str = "lo", hi: str = "hi", prob: str = "prob") -> DataFrame:
    """Each integer of a half-open bin with an equal part of the bin's probability."""
    ages = F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("age")
    return bins.filter(F.col(hi) > F.col(lo)).select("*", ages).withColumn(prob, F.col(prob) / (F.col(hi) - F.col(lo)))


def blend_grid(bins: DataFrame, first: str, second: str, points: int = 100) -> DataFrame:
    """Blends of two shares for alpha = 0 ... 1 in ``points`` steps, for each bin."""
    grid = bins.sparkSession.range(points).select(F.col("id").cast("int").alias("step"), (F.col("id") / (points - 1)).alias("alpha"))
    return bins.crossJoin(F.broadcast(grid)).withColumn("blended", blend(F.col(first), F.col(second), F.col("alpha")))


def bin_counts(df: DataFrame, value: str, bins: DataFrame) -> DataFrame:
    """Rows in each half-open bin (bin, lo, hi), empty bins included, values outside left out."""
    v = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") < F.col("hi"))
    counted = v.join(F.broadcast(bins), inside).groupBy("bin").agg(F.sum("_n").alias("n"))
    return bins.join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def density_histogram(df: DataFrame, value: Column, lo: int, hi: int) -> DataFrame:
    """Density in unit bins from lo to hi; the last bin also holds hi; values outside are left out."""
    inside = df.select(value.alias("_v")).filter(F.col("_v").between(lo, hi))
    per = inside.groupBy(F.least(F.floor("_v").cast("int"), F.lit(hi - 1)).alias("bin")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(F.lit(0))  # one row per bin
    grid = df.sparkSession.range(lo, hi).select(F.col("id").cast("int").alias("bin"))
    counted = grid.join(F.broadcast(per), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.withColumn("density", F.try_divide(F.col("n"), F.sum("n").over(total)))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(value)


def kernel_density(df: DataFrame, value: str, lo: int, hi: int, factor: float, step: float | None = None) -> DataFrame:
    """Gaussian kernel density at the integers lo..hi-1, normalised to 1; bandwidth is factor times the sample's
    standard deviation.

    Equal values are counted first, and all else comes from these counts; the join with the grid has as many rows as
    different values times grid points. A continuous column needs ``step``: values are then rounded to its multiples,
    which bounds the different values by the column's range.
    """
    x = F.col(value).cast("double")
    x = F.round(x / step) * step if step else x
    counts = df.filter(F.col(value).isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    moments = counts.agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("_m"))
    off = F.col("x") - F.col("_m")
    spread = counts.crossJoin(F.broadcast(moments)).agg(
        (F.sqrt(F.try_divide(F.sum(F.col("n") * off * off), F.max("_n") - 1)) * factor).alias("h")
    )
    grid = df.sparkSession.range(lo, hi).select(F.col("id").cast("int").alias("at"))
    kernel = F.col("n") * F.exp(-0.5 * F.pow((F.col("at") - F.col("x")) / F.col("h"), 2))
    raw = (
        counts.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(grid)).groupBy("at").agg(F.sum(kernel).alias("raw"))
    )
    return raw.select("at", (F.col("raw") / F.sum("raw").over(Window.partitionBy(F.lit(0)))).alias("density"))


def binned_kernel_density(df: DataFrame, value: str, lo: int, hi: int, factor: float, error: float = 1e-4) -> DataFrame:
    """``kernel_density`` of a continuous column of any size, off by at most ``error`` at every point before the values are
    normalised, where a single value's kernel has its peak 1 and values count with 1/n each.

    Each value is shared by its two neighbours on a grid, by its distance from either, and only the grid's nodes are
    weighed at the points within the kernel's reach. A step of h sqrt(4 error) makes the sharing off by less than half
    the error (the kernel's second derivative is 1 / h^2 at most, and sharing errs by step^2 / 8 of it), and the kernel
    is cut where it falls below the other half. So the rows of the join are bounded by the points' range in bandwidths
    and the error, not by how many different values there are. A table without two different values has no density.
    """
    x = F.col(value).cast("double")
    given = df.filter(F.col(value).isNotNull())
    h = given.agg((F.stddev_samp(x) * factor).alias("h")).filter("h > 0")  # one row
    step, reach = F.col("h") * (4 * error) ** 0.5, F.col("h") * (-2 * math.log(error / 2)) ** 0.5
    held = given.select(x.alias("x")).crossJoin(F.broadcast(h.select("h", step.alias("step"), reach.alias("reach"))))
    held = held.filter(F.col("x").between(lo - F.col("reach") - F.col("step"), hi - 1 + F.col("reach") + F.col("step")))
    low, part = F.floor(F.col("x") / F.col("step")), F.col("x") / F.col("step") - F.floor(F.col("x") / F.col("step"))
    shares = F.explode(F.array(F.struct(low.alias("node"), (1 - part).alias("w")), F.struct((low + 1).alias("node"), part.alias("w")))).alias("s")
    nodes = held.select("h", "step", "reach", shares).groupBy("h", "step", "reach", "s.node").agg(F.sum("s.w").alias("w"))
    place = F.col("node") * F.col("step")
    first = F.greatest(F.ceil(place - F.col("reach")), F.lit(lo)).cast("int")
    last = F.least(F.floor(place + F.col("reach")), F.lit(hi - 1)).cast("int")
    seen = nodes.filter(first <= last).select("w", place.alias("place"), "h", F.explode(F.sequence(first, last)).alias("at"))
    kernel = F.col("w") * F.exp(-0.5 * F.pow((F.col("at") - F.col("place")) / F.col("h"), 2))
    raw = seen.groupBy("at").agg(F.sum(kernel).alias("raw"))
    grid = df.sparkSession.range(lo, hi).select(F.col("id").cast("int").alias("at"))
    every = grid.join(F.broadcast(raw), "at", "left").select("at", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    return every.select("at", F.try_divide("raw", F.sum("raw").over(Window.partitionBy(F.lit(0)))).alias("density"))
