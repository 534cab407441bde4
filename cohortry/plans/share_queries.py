"""Distribution, probability and sensitivity queries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions import blend, body, rates
from cohortry.operators import distribution as dist
from cohortry.operators import sensitivity

BINS = [(0, 0, 5), (1, 5, 14), (2, 14, 19), (3, 19, 45), (4, 45, 74)]
EDGES = [0, 5, 14, 19, 45, 74]
_BINS_SQL = "bins(bin, lo, hi) AS (VALUES (0, 0, 5), (1, 5, 14), (2, 14, 19), (3, 19, 45), (4, 45, 74))"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BINS, "bin int, lo int, hi int")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Share of each market segment among a nation's customers."""
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = c.groupBy("n_regionkey", "n_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return dist.normalised(counts, ["n_regionkey", "n_nationkey"], "n")


_SEGMENTS = """
c AS (SELECT n_regionkey, n_nationkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY n_regionkey, n_nationkey) AS share FROM c)
"""


def segment_shares(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).withColumn("share", F.round("share", 9))


SEGMENT_SHARES = f"WITH {_SEGMENTS} SELECT n_regionkey, n_nationkey, c_mktsegment, n, round(share, 9) AS share FROM s"


def mean_segment_shares(spark: SparkSession, d: str) -> DataFrame:
    return dist.mean_shares(_segments(spark, d), ["n_regionkey"], "c_mktsegment", "share").withColumn(
        "mean_share", F.round("mean_share", 9)
    )


MEAN_SEGMENT_SHARES = f"WITH {_SEGMENTS} SELECT n_regionkey, c_mktsegment, round(avg(share), 9) AS mean_share FROM s GROUP BY ALL"


def _spread(spark: SparkSession, d: str) -> DataFrame:
    means = dist.mean_shares(_segments(spark, d), ["n_regionkey"], "c_mktsegment", "share")
    c = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    known = dist.normalised(c.withColumn("all", F.lit(1)), ["all"], "n").select("c_mktsegment", (F.col("share") / 2).alias("known"))
    return dist.spread_missing(means.join(F.broadcast(known), "c_mktsegment"), ["n_regionkey"], "c_mktsegment", "known", "mean_share")


def spread_missing(spark: SparkSession, d: str) -> DataFrame:
    return _spread(spark, d).select(
        "n_regionkey", "c_mktsegment", *[F.round(c, 8).alias(c) for c in ("known", "mean_share", "added", "adjusted")]
    )


SPREAD_MISSING = f"""
WITH {_SEGMENTS},
m AS (SELECT n_regionkey, c_mktsegment, avg(share) AS mean_share FROM s GROUP BY ALL),
k AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer) / 2 AS known FROM customer GROUP BY ALL),
x AS (SELECT *, mean_share - known AS dev, 1 - sum(known) OVER (PARTITION BY n_regionkey) AS u FROM m JOIN k USING (c_mktsegment)),
z AS (SELECT *, row_number() OVER w AS k, sum(dev) OVER w AS cs FROM x WINDOW w AS (PARTITION BY n_regionkey ORDER BY dev DESC, c_mktsegment ROWS UNBOUNDED PRECEDING)),
l AS (SELECT n_regionkey, arg_max((cs - u) / k, k) FILTER (dev > (cs - u) / k) AS level FROM z GROUP BY n_regionkey)
SELECT n_regionkey, c_mktsegment, round(known, 8) AS known, round(mean_share, 8) AS mean_share,
       round(greatest(dev - level, 0.0), 8) AS added, round(known + greatest(dev - level, 0.0), 8) AS adjusted
FROM z JOIN l USING (n_regionkey)
"""


def bad_share_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums that miss 1: the adjusted shares of each region should give none, and the known ones all."""
    both = _spread(spark, d)
    a = dist.bad_sums(both, ["n_regionkey"], "adjusted").select(F.lit("adjusted").alias("kind"), "n_regionkey", "n")
    b = dist.bad_sums(both, ["n_regionkey"], "known").select(F.lit("known").alias("kind"), "n_regionkey", "n")
    return a.union(b)


BAD_SHARE_SUMS = "SELECT 'known' AS kind, n_regionkey, count(DISTINCT c_mktsegment) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey"


def share_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Nations that have not as many segments as their customers have order priorities."""
    s = _segments(spark, d)
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_nationkey").alias("n_nationkey"), "o_orderstatus").distinct()
    return dist.different_lengths(s, o, "n_nationkey")


SHARE_LENGTHS = """
WITH a AS (SELECT c_nationkey AS n_nationkey, count(DISTINCT c_mktsegment) AS n_left FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
b AS (SELECT c_nationkey AS n_nationkey, count(DISTINCT coalesce(o_orderstatus, '')) AS n_right FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT n_nationkey, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM a FULL JOIN b USING (n_nationkey)
WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)
"""


def segment_intervals(spark: SparkSession, d: str) -> DataFrame:
    s = dist.intervals(_segments(spark, d), ["n_nationkey"], "c_mktsegment", "share")
    return s.select("n_nationkey", "c_mktsegment", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


_INTERVALS = """
r AS (SELECT *, sum(share) OVER w AS run, lead(1) OVER (PARTITION BY n_nationkey ORDER BY c_mktsegment) AS nxt FROM s
      WINDOW w AS (PARTITION BY n_nationkey ORDER BY c_mktsegment ROWS UNBOUNDED PRECEDING)),
i AS (SELECT n_nationkey, c_mktsegment, coalesce(lag(run) OVER (PARTITION BY n_nationkey ORDER BY c_mktsegment), 0.0) AS lo,
             CASE WHEN nxt IS NULL THEN 1.0 ELSE run END AS hi FROM r)
"""
SEGMENT_INTERVALS = f"WITH {_SEGMENTS}, {_INTERVALS} SELECT n_nationkey, c_mktsegment, round(lo, 9) AS lo, round(hi, 9) AS hi FROM i"


def drawn_segments(spark: SparkSession, d: str) -> DataFrame:
    """Orders get a segment by the shares of their customer's nation."""
    i = dist.intervals(_segments(spark, d), ["n_nationkey"], "c_mktsegment", "share").select("n_nationkey", "c_mktsegment", "lo", "hi")
    o = _t(spark, d, "orders").join(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    u = ((F.col("o_orderkey") * 7919) % 10007 + 0.5) / 10007.0
    drawn = dist.draw(o.select("o_orderkey", "n_nationkey", u.alias("u")), i, "u", ["n_nationkey"])
    return drawn.groupBy("n_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


DRAWN_SEGMENTS = f"""
WITH {_SEGMENTS}, {_INTERVALS},
o AS (SELECT c_nationkey AS n_nationkey, ((o_orderkey * 7919) % 10007 + 0.5::DOUBLE) / 10007.0::DOUBLE AS u FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n_nationkey, c_mktsegment, count(*) AS n FROM o JOIN i USING (n_nationkey) WHERE u >= lo AND u < hi GROUP BY ALL
"""


def drawn_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Orders get an age bin by part counts in the bins, without a key."""
    n = dist.bin_counts(_t(spark, d, "part"), "p_size", _bins(spark)).withColumn("all", F.lit(1))
    i = dist.intervals(dist.normalised(n, ["all"], "n"), ["all"], "bin", "share").select("bin", "lo", "hi")
    u = ((F.col("o_orderkey") * 7919) % 10007 + 0.5) / 10007.0
    return dist.draw(_t(spark, d, "orders").select(u.alias("u")), i, "u").groupBy("bin").agg(F.count("*").alias("n"))


DRAWN_SIZES = f"""
WITH {_BINS_SQL}, n AS (SELECT bin, count(p_size) AS n FROM bins LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY bin),
s AS (SELECT bin, n / sum(n) OVER () AS share FROM n),
r AS (SELECT bin, sum(share) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM s),
i AS (SELECT bin, coalesce(lag(run) OVER (ORDER BY bin), 0.0) AS lo, CASE WHEN bin = 4 THEN 1.0 ELSE run END AS hi FROM r),
o AS (SELECT ((o_orderkey * 7919) % 10007 + 0.5::DOUBLE) / 10007.0::DOUBLE AS u FROM orders)
SELECT bin, count(*) AS n FROM o JOIN i ON u >= lo AND u < hi GROUP BY bin
"""


def size_bins(spark: SparkSession, d: str) -> DataFrame:
    return dist.bin_counts(_t(spark, d, "part"), "p_size", _bins(spark)).orderBy("bin")


SIZE_BINS = f"WITH {_BINS_SQL} SELECT bin, lo, hi, count(p_size) AS n FROM bins LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY ALL"


def quantity_bin_labels(spark: SparkSession, d: str) -> DataFrame:
    b = blend.half_open_bin(F.col("l_quantity") + 30, EDGES)
    return _t(spark, d, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


QUANTITY_BIN_LABELS = """
SELECT CASE WHEN q >= 0 AND q < 5 THEN 0 WHEN q >= 5 AND q < 14 THEN 1 WHEN q >= 14 AND q < 19 THEN 2 WHEN q >= 19 AND q < 45 THEN 3
            WHEN q >= 45 AND q < 74 THEN 4 END AS bin, count(*) AS n FROM (SELECT l_quantity + 30 AS q FROM lineitem) GROUP BY 1
"""


def quantity_density(spark: SparkSession, d: str) -> DataFrame:
    return dist.density_histogram(_t(spark, d, "lineitem"), F.col("l_quantity"), 0, 50).withColumn("density", F.round("density", 9))


QUANTITY_DENSITY = """
WITH h AS (SELECT least(floor(l_quantity)::INT, 49) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1)
SELECT g::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(n) OVER (), 9) AS density FROM range(0, 50) t(g) LEFT JOIN h ON g = bin
"""


def size_counts(spark: SparkSession, d: str) -> DataFrame:
    return dist.value_counts(_t(spark, d, "part"), "p_size")


SIZE_COUNTS = "SELECT p_size, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY p_size ORDER BY p_size"


def _size_shares(spark: SparkSession, d: str) -> DataFrame:
    n = dist.bin_counts(_t(spark, d, "part"), "p_size", _bins(spark)).withColumn("all", F.lit(1))
    return dist.normalised(n, ["all"], "n", "prob").drop("all", "n")


def single_age_shares(spark: SparkSession, d: str) -> DataFrame:
    return dist.single_ages(_size_shares(spark, d)).select("bin", "age", F.round("prob", 9).alias("prob"))


SINGLE_AGE_SHARES = f"""
WITH {_BINS_SQL}, n AS (SELECT bin, lo, hi, count(p_size) AS n FROM bins LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER () AS prob FROM n)
SELECT bin, age::INT AS age, round(prob / (hi - lo), 9) AS prob FROM (SELECT *, unnest(range(lo, hi)) AS age FROM s)
"""


def blended_shares(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q"))
    other = dist.bin_counts(line, "q", _bins(spark)).withColumn("all", F.lit(1))
    other = dist.normalised(other, ["all"], "n", "second").select("bin", "second")
    both = _size_shares(spark, d).withColumnRenamed("prob", "first").join(F.broadcast(other), "bin")
    grid = dist.blend_grid(both, "first", "second")
    return grid.select("bin", "step", F.round("alpha", 9).alias("alpha"), F.round("blended", 8).alias("blended"))


BLENDED_SHARES = f"""
WITH {_BINS_SQL},
a AS (SELECT bin, count(p_size) AS n FROM bins LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY bin),
b AS (SELECT bin, count(l_quantity) AS n FROM bins LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY bin),
s AS (SELECT bin, a.n / sum(a.n) OVER () AS x, b.n / sum(b.n) OVER () AS y FROM a JOIN b USING (bin))
SELECT bin, g::INT AS step, round(g / 99, 9) AS alpha, round((1 - g / 99) * x + g / 99 * y, 8) AS blended FROM s, range(100) t(g)
"""


def quantity_kernel(spark: SparkSession, d: str) -> DataFrame:
    return dist.kernel_density(_t(spark, d, "lineitem"), "l_quantity", 1, 51, 0.2).withColumn("density", F.round("density", 8))


QUANTITY_KERNEL = """
WITH h AS (SELECT stddev_samp(l_quantity) * 0.2 AS h FROM lineitem), c AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
r AS (SELECT g, sum(n * exp(-0.5 * pow((g - x) / h, 2))) AS raw FROM c, h, range(1, 51) t(g) GROUP BY g)
SELECT g::INT AS "at", round(raw / sum(raw) OVER (), 8) AS density FROM r
"""


def weekly_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Event counts of each user as yearly rates: any event, error as joint, purchases as a share for the severe kind."""
    n = lambda c: F.sum((F.col("event_type") == c).cast("int"))
    users = _t(spark, d, "events").groupBy("user_id").agg(
        (F.count("*") * 1.0).alias("abr"), (n("error") * 1.0).alias("ajbr"), (n("purchase") / F.count("*")).alias("ltb"),
        F.when(F.col("user_id") % 2 == 0, F.lit("annual")).otherwise("weekly").alias("period"),
    )
    out = rates.bleed_probabilities(users, "abr", "ajbr", "ltb")
    return out.select(
        "user_id", *[F.round(c, 9).alias(c) for c in ("minor", "major", "life_threatening", "weekly_severe", "healthy")],
        F.round(rates.at_least_one(F.col("ajbr"), F.col("period")), 9).alias("by_period"),
        F.round(rates.no_event(F.col("ajbr"), F.col("period")), 9).alias("none_by_period"),
    )


WEEKLY_PROBABILITIES = """
WITH u AS (SELECT user_id, count(*)::DOUBLE AS abr, sum((event_type = 'error')::INT)::DOUBLE AS ajbr, sum((event_type = 'purchase')::INT) / count(*) AS ltb FROM events GROUP BY user_id),
p AS (SELECT *, 1 - exp(-(abr - ajbr) / 52) AS minor, 1 - exp(-ajbr / 52) AS major, 1 - exp(-ltb / 52) AS lt,
             CASE WHEN user_id % 2 = 0 THEN ajbr / 52 ELSE ajbr END AS lam FROM u)
SELECT user_id, round(minor, 9) AS minor, round(major, 9) AS major, round(lt, 9) AS life_threatening, round(ltb / 52, 9) AS weekly_severe,
       round(1 - (minor + major + lt), 9) AS healthy, round(1 - exp(-lam), 9) AS by_period, round(exp(-lam), 9) AS none_by_period FROM p
"""


def body_weights(spark: SparkSession, d: str) -> DataFrame:
    weeks = _t(spark, d, "orders").select((F.col("o_orderkey") % 3797).cast("int").alias("week")).distinct()
    return weeks.select(
        "week", body.growth_weight(F.col("week")).alias("growth"), body.staged_weight(F.col("week")).alias("staged"),
        F.round(body.linear_survival(blend.years(F.col("week"))), 9).alias("survival"),
    )


BODY_WEIGHTS = """
WITH w AS (SELECT DISTINCT (o_orderkey % 3797)::INT AS week FROM orders)
SELECT week, round_even(CASE WHEN week <= 2600 THEN 80.5 * exp(-3.08 * exp(-0.00255 * week)) ELSE 80.0 - 5.0 * (week - 2600) / 1196 END::DOUBLE, 2) AS growth,
       round_even(CASE WHEN week <= 104 THEN greatest(3.5, 12 / (1 + exp(-0.05 * (week - 52)))) WHEN week <= 624 THEN 12 + (week - 104) * (28 / 520)
            WHEN week <= 936 THEN 40 + (week - 624) * (30 / 312) WHEN week <= 3380 THEN 70 + 5 * sin(week / 520) ELSE 70 - (week - 3380) * 5 / 416 END::DOUBLE, 2) AS staged,
       round(greatest(0.0, least(1.0, (100 - week / 52) / 100)), 9) AS survival
FROM w
"""


def _numbered(rows: DataFrame, mixed: Column, modulus: int, name: str) -> DataFrame:
    """``rows`` with ``k`` (0, 1, ...), their place in the whole table ordered by ``mixed`` (0 .. modulus - 1) and keys.

    Ranges of ``mixed`` are ordered each by itself; their offsets are one row per range.
    """
    rows = rows.withColumn("m", mixed).withColumn("r", F.floor(F.col("m") * 4096 / modulus))
    counts = rows.groupBy("r").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("r")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("r").orderBy("m", "l_orderkey", "l_linenumber", "x1", "x2", "x3"))
    numbered = rows.withColumn("at", place).join(F.broadcast(counts.select("r", before.alias("offset"))), "r")
    values = [F.col(c).alias(f"{name}{c[1:]}") for c in rows.columns if c.startswith("x")]
    return numbered.select((F.col("offset") + F.col("at") - 1).alias("k"), *values)


def paired_rows(rows: DataFrame) -> DataFrame:
    """Each row with the row of equal rank in a second order of the whole table, whatever the table's size."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    a = _numbered(rows, (o * 15_485_863 + n.cast("long") * 32_452_843) % 1_000_033, 1_000_033, "a")
    return a.join(_numbered(rows, (o * 7919 + n * 104_729) % 1_000_003, 1_000_003, "b"), "k")


def _indices(pairs: DataFrame) -> DataFrame:
    """Sensitivity of a fixed polynomial to its three inputs, from rows of both blocks (a1 .. a3, b1 .. b3)."""
    y = lambda *x: F.col(x[0]) + 2 * F.col(x[1]) * F.col(x[1]) + 3 * F.col(x[2]) * F.col(x[0])
    blocks = {"A": ("a1", "a2", "a3"), "B": ("b1", "b2", "b3"), "AB_1": ("b1", "a2", "a3"), "AB_2": ("a1", "b2", "a3"), "AB_3": ("a1", "a2", "b3")}
    rows = pairs.select(*[y(*x).alias(n) for n, x in blocks.items()])
    out = sensitivity.sobol_of_rows(rows, "A", "B", ["AB_1", "AB_2", "AB_3"])
    return out.select("input", F.round("s1", 6).alias("s1"), F.round("st", 6).alias("st"))


def input_sensitivity_whole(spark: SparkSession, d: str) -> DataFrame:
    """Indices of three columns of lineitem for a fixed polynomial; block B is the row of equal rank in a second order of
    the whole table."""
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_tax") * 12).alias("x3"))
    return _indices(paired_rows(l))


INPUT_SENSITIVITY_WHOLE = """
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 12 AS x3,
                  (l_orderkey * 15485863 + l_linenumber::BIGINT * 32452843) % 1000033 AS ma, (l_orderkey * 7919 + l_linenumber * 104729) % 1000003 AS mb FROM lineitem),
a AS (SELECT row_number() OVER (ORDER BY ma, o, n, x1, x2, x3) AS k, x1 AS a1, x2 AS a2, x3 AS a3 FROM l),
b AS (SELECT row_number() OVER (ORDER BY mb, o, n, x1, x2, x3) AS k, x1 AS b1, x2 AS b2, x3 AS b3 FROM l),
y AS (SELECT a1 + 2*a2*a2 + 3*a3*a1 AS a, b1 + 2*b2*b2 + 3*b3*b1 AS b, b1 + 2*a2*a2 + 3*a3*b1 AS c1, a1 + 2*b2*b2 + 3*a3*a1 AS c2, a1 + 2*a2*a2 + 3*b3*a1 AS c3
      FROM a JOIN b USING (k)),
s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM (SELECT unnest([a, b, c1, c2, c3]) AS v FROM y)),
z AS (SELECT (a - m) / s AS a, (b - m) / s AS b, (c1 - m) / s AS c1, (c2 - m) / s AS c2, (c3 - m) / s AS c3 FROM y, s),
v AS (SELECT var_pop(w) AS v FROM (SELECT unnest([a, b]) AS w FROM z)),
r AS (SELECT unnest([1, 2, 3]) AS input, unnest([avg(b*(c1-a)), avg(b*(c2-a)), avg(b*(c3-a))]) AS s1,
             unnest([avg((a-c1)*(a-c1))/2, avg((a-c2)*(a-c2))/2, avg((a-c3)*(a-c3))/2]) AS st FROM z)
SELECT input, round(s1 / v, 6) AS s1, round(st / v, 6) AS st FROM r, v
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (segment_shares, SEGMENT_SHARES), (mean_segment_shares, MEAN_SEGMENT_SHARES), (spread_missing, SPREAD_MISSING),
        (bad_share_sums, BAD_SHARE_SUMS), (share_lengths, SHARE_LENGTHS), (segment_intervals, SEGMENT_INTERVALS),
        (drawn_segments, DRAWN_SEGMENTS), (drawn_sizes, DRAWN_SIZES), (size_bins, SIZE_BINS),
        (quantity_bin_labels, QUANTITY_BIN_LABELS), (quantity_density, QUANTITY_DENSITY), (size_counts, SIZE_COUNTS),
        (single_age_shares, SINGLE_AGE_SHARES), (blended_shares, BLENDED_SHARES), (quantity_kernel, QUANTITY_KERNEL),
        (weekly_probabilities, WEEKLY_PROBABILITIES), (body_weights, BODY_WEIGHTS), (input_sensitivity_whole, INPUT_SENSITIVITY_WHOLE),
    )
}
