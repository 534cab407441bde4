"""Sensitivity with confidence, alias tables and binned densities, against plain versions."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions.weights import POISSON_CUTS, PRIME, poisson, with_hashed
from cohortry.operators import distribution as dist
from cohortry.operators import sensitivity
from cohortry.plans import estimate_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashed_weights_are_poisson(spark):
    df = spark.range(20_000).withColumn("r", (F.col("id") % 7).cast("int"))
    rows = with_hashed(df, "id", "r").select("id", "r", "hashed", poisson(F.col("hashed")).alias("w")).collect()
    for r in rows[:50]:
        t, salt = r.id % PRIME, (r.r + 1) * 179_424_673 % PRIME
        for factor, shift in ((1_540_483_477, 0), (1_103_515_245, 13), (747_796_405, 16)):
            t = ((t ^ (t >> shift) if shift else t) * factor + salt) % PRIME
        assert r.hashed == t and r.w == sum(t >= c for c in POISSON_CUTS)
    share = Counter(r.w for r in rows)
    assert all(abs(share[k] / len(rows) - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(5))


def _blocks(f, n=3000, inputs=3, seed=2):
    rng = np.random.default_rng(seed)
    a, b = rng.random((n, inputs)), rng.random((n, inputs))
    out = {"A": f(a), "B": f(b)}
    for i in range(inputs):
        for name, x, y in (("AB", a, b), ("BA", b, a)):
            m = x.copy()
            m[:, i] = y[:, i]
            out[f"{name}_{i + 1}"] = f(m)
    return out


def _plain(blocks, inputs=3):
    every = np.concatenate(list(blocks.values()))
    z = {n: (v - every.mean()) / every.std() for n, v in blocks.items()}
    var = np.concatenate([z["A"], z["B"]]).var()
    s1 = [np.mean(z["B"] * (z[f"AB_{i}"] - z["A"])) / var for i in range(1, inputs + 1)]
    st = [np.mean((z["A"] - z[f"AB_{i}"]) ** 2) / 2 / var for i in range(1, inputs + 1)]
    s2 = {
        (i, j): np.mean(z[f"BA_{i}"] * z[f"AB_{j}"] - z["A"] * z["B"]) / var - s1[i - 1] - s1[j - 1]
        for i in range(1, inputs + 1) for j in range(i + 1, inputs + 1)
    }
    return s1, st, s2


def test_sensitivity_with_confidence(spark):
    blocks = _blocks(lambda x: x[:, 0] + 4 * x[:, 1] * x[:, 2])
    rows = [(k, *map(float, r)) for k, r in enumerate(zip(*blocks.values()))]
    rows.append((9_999_999, None, *[1.0] * 7))  # lacks an evaluation
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in blocks))
    names = [[f"{x}_{i}" for i in (1, 2, 3)] for x in ("AB", "BA")]
    got = {(r.kind, r.input, r.other): (r.value, r.conf) for r in sensitivity.sobol_with_confidence(df, "k", "A", "B", *names).collect()}
    s1, st, s2 = _plain(blocks)
    for i in (1, 2, 3):
        assert got["s1", i, None][0] == pytest.approx(s1[i - 1], abs=1e-9)
        assert got["st", i, None][0] == pytest.approx(st[i - 1], abs=1e-9)
    assert {k[1:]: v[0] for k, v in got.items() if k[0] == "s2"} == {k: pytest.approx(v, abs=1e-9) for k, v in s2.items()}
    assert got["s2", 2, 3][0] > 0.1 > abs(got["s2", 1, 2][0])
    rng = np.random.default_rng(5)
    tries = [_plain({n: v[pick] for n, v in blocks.items()}) for pick in (rng.integers(0, 3000, 3000) for _ in range(200))]
    for i in (1, 2, 3):
        assert got["s1", i, None][1] == pytest.approx(1.96 * np.std([t[0][i - 1] for t in tries]), rel=0.35)
    assert sensitivity.sobol_with_confidence(df.limit(0), "k", "A", "B", *names).collect() == []
    text = plan(sensitivity.sobol_with_confidence(df, "k", "A", "B", *names))
    assert "Python" not in text


def test_sensitivity_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(k, *[2.0] * 4) for k in range(5)], "k long, a double, b double, c double, d double")
    got = sensitivity.sobol_with_confidence(df, "k", "a", "b", ["c"], ["d"], 10).collect()
    assert {r.kind for r in got} == {"s1", "st"} and all(r.value is None and r.conf is None for r in got)


@pytest.mark.parametrize("weights", [[1], [5, 5, 5], [1, 2, 3, 4, 90], [0, 7, 0, 1], [10**12, 1, 3], list(range(1, 40)), [2, 1, 1, 4, 4, 4, 4, 4]])
def test_alias_tables_hold_exact_shares(spark, weights):
    df = spark.createDataFrame([("g", f"o{k:02}", w) for k, w in enumerate(weights)], "g string, o string, n long")
    (row,) = dist.alias_tables(df, ["g"], "o", "n").collect()
    share, given = Counter(), [w for w in weights if w]
    assert row.total == sum(given) and len(row.cells) == len(given)
    for c in row.cells:
        assert 0 <= c.keep <= row.total and (c.alias is not None or c.keep == row.total)
        share[c.own] += Fraction(c.keep, row.total * len(given))
        if c.keep < row.total:
            share[c.alias] += Fraction(row.total - c.keep, row.total * len(given))
    assert share == {f"o{k:02}": Fraction(w, sum(given)) for k, w in enumerate(weights) if w}


def test_alias_draws_agree_with_interval_draws(spark):
    """Over an even grid of numbers both ways give each outcome its share within the cells' edges."""
    weights = [("a", "x", 3), ("a", "y", 1), ("a", "z", 6), ("b", "y", 1), ("b", "w", 2)]
    df = spark.createDataFrame(weights, "g string, o string, n long")
    n = 6000
    rows = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("none"))).alias("g"))
    drawn = dist.draw_by_alias(rows, dist.alias_tables(df, ["g"], "o", "n"), "u", ["g"], "drawn")
    assert "NestedLoop" not in plan(drawn) and "Python" not in plan(drawn)
    got = Counter((r.g, r.drawn) for r in drawn.collect())
    total = {"a": 10, "b": 3}
    assert set(got) == {(g, o) for g, o, _ in weights}
    assert all(abs(got[g, o] - n * w / total[g]) <= 6 for g, o, w in weights)


def test_binned_density_keeps_its_error(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(20, 4, 4000), rng.gamma(2, 9, 3000), [-500.0, 900.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for error in (1e-2, 1e-4):
        out = dist.binned_kernel_density(df, "v", 0, 60, 0.2, error)
        got = np.array([r.density for r in out.orderBy("at").collect()])
        h = 0.2 * v.std(ddof=1)
        raw = np.exp(-0.5 * ((np.arange(60)[:, None] - v[None, :]) / h) ** 2).sum(1)
        # each raw value is off by at most error * n, so is their sum for each of the 60 points
        most = (error * len(v) * (1 + 60 * raw / raw.sum())) / (raw.sum() - 60 * error * len(v))
        assert np.all(np.abs(got - raw / raw.sum()) <= most)
    assert [r.density for r in dist.binned_kernel_density(df.limit(0), "v", 0, 3, 0.2).collect()] == [None] * 3


def test_binned_density_rows_do_not_grow_with_the_values(spark):
    """The nodes are bounded by the points' range in bandwidths and the error."""
    wide = spark.range(50_000).select((F.col("id") * 0.001).alias("v"))
    out = dist.binned_kernel_density(wide, "v", 0, 50, 0.2, 1e-2)
    h = 0.2 * np.std(np.arange(50_000) * 0.001, ddof=1)
    assert out.count() == 50 and (50 + 2 * h * 4) / (h * (4e-2) ** 0.5) < 200
    assert "Cartesian" not in plan(out) and "Python" not in plan(out)


def test_queries_are_registered():
    assert set(estimate_queries.QUERIES) == {"sensitivity_confidence", "alias_draws", "price_kernel"}
