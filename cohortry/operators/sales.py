"""Sales totals, unit prices, common-row joins and count profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.text import unit_dose


def unit_price(amount: Column, count: Column) -> Column:
    """Amount per item, rounded half to even; null where the count is 0."""
    return F.bround(F.try_divide(amount, count))


def total_sales(
    df: DataFrame, key: str = "generic_name", count: str = "sale_count", amount: str = "sale_amount"
) -> DataFrame:
    """Key, both sums, rows and unit price; null keys are dropped and sums of nulls are 0."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.coalesce(F.sum(count), F.lit(0)).alias(count),
            F.coalesce(F.sum(amount), F.lit(0)).alias(amount),
            F.count("*").alias("n_rows"),
        )
        .withColumn("price_per_package", unit_price(F.col(amount), F.col(count)))
    )


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of both, in the left one's order."""
    return [c for c in left.columns if c in set(right.columns)]


#: Equal rows that one step of ``merge_common_columns`` writes out at most.
PIECE = 65_536


def merge_common_columns(left: DataFrame, right: DataFrame, piece: int = PIECE) -> DataFrame:
    """Full outer join on all common columns, cut down to them; nulls match nulls and repeated rows multiply.

    Only the common columns stay, so rows of one key are alike: both sides are counted by key, keys meet once, and a
    key's rows are written out by the product of its counts. A key that holds a third of the rows is summed before any
    shuffle, and the rows of a large product are dealt to all tasks in pieces.
    """
    names = common_columns(left, right)
    sides = [
        df.select(*[F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(names)], *[(F.lit(1) if n == s else F.lit(0)).alias(n) for n in ("l", "r")])
        for df, s in ((left, "l"), (right, "r"))
    ]
    keys = [f"c_{k}" for k in range(len(names))]
    counts = sides[0].union(sides[1]).groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    counts = counts.select(*keys, (F.greatest("l", F.lit(1)) * F.greatest("r", F.lit(1))).alias("n"))
    pieces = F.floor((F.col("n") - 1) / piece).cast("long")
    each = F.explode(F.sequence(F.lit(0).cast("long"), pieces)).alias("at")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = counts.filter(F.col("n") > piece).select(*keys, "n", each).repartition(tasks)
    large = large.select(*keys, F.least(F.lit(piece).cast("long"), F.col("n") - F.col("at") * piece).alias("n"))
    every = counts.filter(F.col("n") <= piece).union(large)
    out = every.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, names, strict=True)])


def brand_totals(
    df: DataFrame, key: str, names: Sequence[str], measures: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """By key: the first non-null of each name in the given order, and sums of the measures."""
    place = F.struct(*order)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in names]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in measures]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*first, *sums)


def first_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; null is one key."""
    place = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def part_profile(df: DataFrame, part: str, counted: str, distinct: Sequence[str]) -> DataFrame:
    """By part: non-null count of a column, and numbers of different values, where null is a value."""
    return df.groupBy(part).agg(
        F.count(counted).alias(f"n_{counted}"),
        *[
            (F.count_distinct(c) + F.max(F.col(c).isNull().cast("bigint"))).alias(f"different_{c}")
            for c in distinct
        ],
        F.count("*").alias("n_rows"),
    )


def unit_consumption(df: DataFrame, part: str, name: str, units: str, whole_part: bool = False) -> DataFrame:
    """Dose times units by part and name, for names with a dose.

    ``whole_part``: each distinct name's dose times the units of all rows of the part, those of other names included.
    Units are summed by part and name first, so a dose is read once for each name of a part, not for each row.
    """
    totals = df.groupBy(part, name).agg(F.sum(units).alias("_units"))
    if whole_part:
        of_part = totals.groupBy(part).agg(F.coalesce(F.sum("_units"), F.lit(0)).alias("_units"))
        totals = totals.select(part, name).join(of_part, part)
    dosed = totals.withColumn("dose", unit_dose(F.col(name))).filter("dose is not null")
    return dosed.select(part, name, (F.col("dose") * F.col("_units")).alias("total_iu"))


def overall_consumption(by_name: DataFrame) -> DataFrame:
    """One row: the sum of ``total_iu`` over all parts and names, 0 without any."""
    return by_name.agg(F.coalesce(F.sum("total_iu"), F.lit(0)).alias("total_iu"))


def sketched_profile(df: DataFrame, part: str, counted: str, distinct: Sequence[str], lg_k: int = 12) -> DataFrame:
    """``part_profile`` by mergeable sketches: one pass, no row repeated for each counted column, and a part's state is
    2^lg_k small cells a column at most, however many values it has. Numbers of different values are off by a standard
    error of 1.04 / 2^(lg_k / 2), 1.6 % by default; null is a value."""
    def different(c: str) -> Column:
        values = F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), lg_k))
        return (F.coalesce(values, F.lit(0)) + F.max(F.col(c).isNull().cast("bigint"))).alias(f"about_{c}")

    return df.groupBy(part).agg(F.count(counted).alias(f"n_{counted}"), *[different(c) for c in distinct], F.count("*").alias("n_rows"))
