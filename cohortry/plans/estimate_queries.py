"""Queries of estimates: sensitivity with confidence, draws from alias tables, densities of continuous columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.weights import hashed_sql, poisson_sql
from cohortry.operators import distribution as dist
from cohortry.operators import sensitivity
from cohortry.plans.share_queries import paired_rows

REPLICATES = 100


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sensitivity_confidence(spark: SparkSession, d: str) -> DataFrame:
    """First, total and second order indices of three columns of lineitem for a fixed polynomial, with the confidence
    that 100 resamples give; block B is the row of equal rank in a second order of the whole table."""
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_tax") * 12).alias("x3"))
    y = lambda *x: F.col(x[0]) + 2 * F.col(x[1]) * F.col(x[1]) + 3 * F.col(x[2]) * F.col(x[0])
    mix = lambda one, other, i: [f"{other if i == k else one}{k}" for k in (1, 2, 3)]
    blocks = {"A": mix("a", "b", 0), "B": mix("b", "a", 0)}
    blocks |= {f"AB_{i}": mix("a", "b", i) for i in (1, 2, 3)} | {f"BA_{i}": mix("b", "a", i) for i in (1, 2, 3)}
    rows = paired_rows(l).select("k", *[y(*x).alias(n) for n, x in blocks.items()])
    out = sensitivity.sobol_with_confidence(rows, "k", "A", "B", [f"AB_{i}" for i in (1, 2, 3)], [f"BA_{i}" for i in (1, 2, 3)], REPLICATES)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "conf")})


_INPUTS = (1, 2, 3)
_PAIRS = [(1, 2), (1, 3), (2, 3)]
_Y = "{0}1 + 2*{1}2*{1}2 + 3*{2}3*{0}1"


def _mixed(one: str, other: str, i: int) -> str:
    return _Y.format(*[other if i == k else one for k in _INPUTS])


SENSITIVITY_CONFIDENCE = f"""
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 12 AS x3,
                  (l_orderkey * 15485863 + l_linenumber::BIGINT * 32452843) % 1000033 AS ma, (l_orderkey * 7919 + l_linenumber * 104729) % 1000003 AS mb FROM lineitem),
a AS (SELECT row_number() OVER (ORDER BY ma, o, n, x1, x2, x3) - 1 AS k, x1 AS a1, x2 AS a2, x3 AS a3 FROM l),
b AS (SELECT row_number() OVER (ORDER BY mb, o, n, x1, x2, x3) - 1 AS k, x1 AS b1, x2 AS b2, x3 AS b3 FROM l),
y AS (SELECT k, {_mixed("a", "b", 0)} AS a, {_mixed("b", "a", 0)} AS b, {", ".join(f"{_mixed('a', 'b', i)} AS c{i}, {_mixed('b', 'a', i)} AS d{i}" for i in _INPUTS)} FROM a JOIN b USING (k)),
h AS (SELECT y.*, r, {hashed_sql("k", "r")} AS h FROM y, range({REPLICATES + 1}) t(r)),
w AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE {poisson_sql("h")} END::DOUBLE AS w FROM h),
g AS (SELECT avg(v) AS m FROM (SELECT unnest([a, b, {", ".join(f"c{i}, d{i}" for i in _INPUTS)}]) AS v FROM y)),
s AS (SELECT r, sum(w) AS n, sum(w * (a + b)) / (2 * sum(w)) AS mean, sum(w * (a * a + b * b)) / (2 * sum(w)) AS sq,
      {", ".join(f"sum(w * (b - m) * (c{i} - a)) / sum(w) AS p{i}, sum(w * (a - c{i}) * (a - c{i})) / (2 * sum(w)) AS e{i}" for i in _INPUTS)},
      {", ".join(f"sum(w * ((d{i} - m) * (c{j} - m) - (a - m) * (b - m))) / sum(w) AS v{i}{j}" for i, j in _PAIRS)} FROM w, g GROUP BY r),
v AS (SELECT *, sq - mean * mean AS var FROM s),
u AS (SELECT r, unnest([{", ".join([*[f"{{'kind': 's1', 'input': {i}, 'other': NULL::INT, 'value': p{i} / var}}" for i in _INPUTS], *[f"{{'kind': 'st', 'input': {i}, 'other': NULL::INT, 'value': e{i} / var}}" for i in _INPUTS], *[f"{{'kind': 's2', 'input': {i}, 'other': {j}, 'value': v{i}{j} / var - p{i} / var - p{j} / var}}" for i, j in _PAIRS]])}]) AS c FROM v)
SELECT c.kind AS kind, c.input::INT AS input, c.other::INT AS other, round(max(c.value) FILTER (r = 0), 6) AS value,
       round(stddev_samp(c.value) FILTER (r > 0) * {sensitivity.Z_95}::DOUBLE, 6) AS conf FROM u GROUP BY 1, 2, 3
"""


def alias_draws(spark: SparkSession, d: str) -> DataFrame:
    """Each order's segment, drawn from its nation's segments by their numbers of customers: draws by nation and segment,
    beside what the table's exact shares expect."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    weights = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    tables = dist.alias_tables(weights, ["c_nationkey"], "c_mktsegment", "n")
    o = _t(spark, d, "orders").select("o_custkey", (((F.col("o_orderkey") * 7919) % 10007 + 0.5) / 10007.0).alias("u"))
    rows = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    drawn = dist.draw_by_alias(rows, tables, "u", ["c_nationkey"], "drawn")
    counts = drawn.groupBy("c_nationkey", "drawn").agg(F.count("*").alias("draws"))
    cells = tables.select("c_nationkey", "total", F.size("cells").alias("k"), F.inline("cells"))
    parts = cells.select("c_nationkey", "total", "k", F.explode(F.array(
        F.struct(F.col("own").alias("drawn"), F.col("keep").alias("part")), F.struct(F.col("alias").alias("drawn"), (F.col("total") - F.col("keep")).alias("part"))
    )).alias("p")).filter("p.part > 0")
    shares = parts.groupBy("c_nationkey", "p.drawn").agg((F.sum("p.part") / F.max(F.col("total") * F.col("k"))).alias("share"))
    return shares.join(counts, ["c_nationkey", "drawn"], "left").select(
        "c_nationkey", "drawn", F.coalesce("draws", F.lit(0)).alias("draws"), F.round("share", 9).alias("share")
    )


ALIAS_DRAWS = """
WITH n AS (SELECT c_nationkey, c_mktsegment AS own, count(*) AS w FROM customer GROUP BY ALL),
h AS (SELECT *, sum(w) OVER g AS total, count(*) OVER g AS k, w * count(*) OVER g AS have FROM n WINDOW g AS (PARTITION BY c_nationkey)),
f AS (SELECT *, have >= total AS heavy, abs(have - total) AS off FROM h),
t AS (SELECT *, sum(off) OVER (PARTITION BY c_nationkey, heavy ORDER BY own) AS upto, lead(own) OVER (PARTITION BY c_nationkey, heavy ORDER BY own) AS nxt,
             row_number() OVER (PARTITION BY c_nationkey ORDER BY own) - 1 AS cell FROM f),
filler AS (SELECT x.c_nationkey, x.own, min(y.own) AS filler FROM t x JOIN t y ON x.c_nationkey = y.c_nationkey AND NOT x.heavy AND y.heavy AND y.upto >= x.upto - x.off GROUP BY ALL),
short AS (SELECT x.c_nationkey, x.own, min(y.upto) AS short FROM t x JOIN t y ON x.c_nationkey = y.c_nationkey AND x.heavy AND NOT y.heavy AND y.upto > x.upto GROUP BY ALL),
a AS (SELECT t.*, CASE WHEN heavy THEN total - coalesce(short - upto, 0) ELSE have END AS keep, CASE WHEN NOT heavy THEN filler WHEN short IS NOT NULL THEN nxt END AS other
      FROM t LEFT JOIN filler USING (c_nationkey, own) LEFT JOIN short USING (c_nationkey, own)),
o AS (SELECT c_nationkey, ((o_orderkey * 7919) % 10007 + 0.5::DOUBLE) / 10007.0::DOUBLE AS u FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT o.c_nationkey, CASE WHEN (u * k - floor(u * k)) * total < keep THEN own ELSE other END AS drawn FROM o JOIN a ON o.c_nationkey = a.c_nationkey AND cell = floor(u * k)),
s AS (SELECT c_nationkey, own AS drawn, w / total AS share FROM h)
SELECT s.c_nationkey, s.drawn, count(p.drawn) AS draws, round(any_value(share), 9) AS share FROM s LEFT JOIN p ON s.c_nationkey = p.c_nationkey AND s.drawn = p.drawn GROUP BY 1, 2
"""


def price_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of the order price, a continuous column, in steps of 10,000."""
    o = _t(spark, d, "orders").select((F.col("o_totalprice").cast("double") / 10_000).alias("price"))
    return dist.binned_kernel_density(o, "price", 0, 60, 0.2).withColumn("density", F.round("density", 8))


PRICE_KERNEL = """
WITH p AS (SELECT o_totalprice::DOUBLE / 10000 AS x FROM orders WHERE o_totalprice IS NOT NULL),
h AS (SELECT h, h * sqrt(4 * 1e-4::DOUBLE) AS step, h * sqrt(-2 * ln(1e-4::DOUBLE / 2)) AS reach FROM (SELECT stddev_samp(x) * 0.2::DOUBLE AS h FROM p) WHERE h > 0),
n AS (SELECT h, step, reach, unnest([floor(x / step), floor(x / step) + 1]) AS node, unnest([1 - (x / step - floor(x / step)), x / step - floor(x / step)]) AS w FROM p, h),
c AS (SELECT h, reach, node * step AS place, sum(w) AS w FROM n GROUP BY h, step, reach, node),
r AS (SELECT g AS a, sum(w * exp(-0.5 * pow((g - place) / h, 2))) AS raw FROM c, range(0, 60) t(g) WHERE abs(g - place) <= reach GROUP BY g),
e AS (SELECT g::INT AS a, coalesce(raw, 0) AS raw FROM range(0, 60) t(g) LEFT JOIN r ON g = a)
SELECT a AS "at", round(raw / nullif(sum(raw) OVER (), 0), 8) AS density FROM e
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in ((sensitivity_confidence, SENSITIVITY_CONFIDENCE), (alias_draws, ALIAS_DRAWS), (price_kernel, PRICE_KERNEL))
}
