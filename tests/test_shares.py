"""Distributions, transition tables, paths and sensitivity: fixed values and properties."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators import distribution as dist
from cohortry.operators import matrix, paths, sensitivity
from cohortry.plans import share_queries
from cohortry.sources import dimensions as dim
from cohortry.sources import sinks, tables

KNOWN_A, MEAN_A = [0.01, 0.12, 0.07, 0.37, 0.19], [0.0812857, 0.2255714, 0.1404286, 0.375, 0.1758571]
KNOWN_B, MEAN_B = [0.02, 0.10, 0.06, 0.39, 0.19], [0.0881944, 0.2229167, 0.1229167, 0.3806944, 0.185]


def test_spread_missing_fixed_values(spark):
    rows = [(g, k, x, y) for g, xs, ys in (("a", KNOWN_A, MEAN_A), ("b", KNOWN_B, MEAN_B)) for k, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "g string, bin int, known double, mean double")
    got = dist.spread_missing(df, ["g"], "bin", "known", "mean").orderBy("g", "bin").collect()
    assert [r.added for r in got[:5]] == pytest.approx([0.0682143, 0.1025, 0.0673571, 0.0019286, 0], abs=1e-6)
    assert [r.added for r in got[5:]] == pytest.approx([0.0635185, 0.1182407, 0.0582407, 0, 0], abs=1e-6)
    out = dist.spread_missing(df, ["g"], "bin", "known", "mean")
    assert dist.bad_sums(out, ["g"], "adjusted").isEmpty()
    assert out.filter("adjusted < known").isEmpty()


def test_intervals_tile(spark):
    df = spark.createDataFrame([("g", k, p) for k, p in enumerate([0.1, 0.2, 0.7])], "g string, k int, p double")
    got = dist.intervals(df, ["g"], "k", "p").orderBy("k").collect()
    assert got[0].lo == 0.0 and got[-1].hi == 1.0
    assert all(a.hi == b.lo for a, b in zip(got, got[1:]))
    u = spark.createDataFrame([(0.0,), (0.1,), (0.9999,)], "u double")
    assert [r.k for r in dist.draw(u, dist.intervals(df, ["g"], "k", "p"), "u").orderBy("u").collect()] == [0, 1, 2]


def test_single_ages_and_bins(spark):
    bins = spark.createDataFrame([(0, 0, 2, 0.5), (1, 2, 3, 0.5), (2, 3, 3, 0.0)], "bin int, lo int, hi int, prob double")
    assert [(r.age, r.prob) for r in dist.single_ages(bins).orderBy("age").collect()] == [(0, 0.25), (1, 0.25), (2, 0.5)]
    df = spark.createDataFrame([(0,), (2,), (2,), (9,), (None,)], "v int")
    assert [r.n for r in dist.bin_counts(df, "v", bins.select("bin", "lo", "hi")).orderBy("bin").collect()] == [1, 2, 0]
    h = dist.density_histogram(df, F.col("v"), 0, 9).collect()
    assert sum(r.density for r in h) == pytest.approx(1) and h[-1].n + 0 == max(r.n for r in h if r.bin == 8)


def test_kernel_density_is_normal_sum(spark):
    import numpy as np

    v = [1.0, 2.0, 2.0, 5.0]
    got = [r.density for r in dist.kernel_density(spark.createDataFrame([(x,) for x in v], "v double"), "v", 0, 8, 0.5).orderBy("at").collect()]
    h = 0.5 * np.std(v, ddof=1)
    raw = np.array([sum(np.exp(-0.5 * ((g - x) / h) ** 2) for x in v) for g in range(8)])
    assert got == pytest.approx(list(raw / raw.sum()))


def _fixed(spark):
    states = dim.stage_states(spark)
    two = dim.treatments(spark).select("regime")
    grid_states = states.crossJoin(two)
    grid = matrix.dense_grid(dim.transition_rules(spark), grid_states, ["regime", "stage"])
    return matrix.normalise_rows(grid, ["regime", "stage"], matrix.repair_policy(spark)), grid_states


GOLDEN = {
    ("on_demand", "early", "minor_bleeding"): {
        "alive_wo_arthropathy": 0.142596, "minor_bleeding": 0.183892, "articular_bleeding": 0.618954, "life_treating_bleeding": 0.048658,
        "inhibitor": 0.005339, "chronic_arthropathy": 0.000561,
    },
    ("on_demand", "early", "life_treating_bleeding"): {
        "alive_wo_arthropathy": 0.95, "minor_bleeding": 0.045836, "inhibitor": 0.00414, "death": 0.000024,
    },
    ("on_demand", "early", "surgery"): {"alive_wo_arthropathy": 0.95, "inhibitor": 0.05},
    ("on_demand", "early", "chronic_arthropathy"): {
        "minor_bleeding": 0.142596, "articular_bleeding": 0.479958, "life_treating_bleeding": 0.037731, "inhibitor": 0.00414,
        "chronic_arthropathy": 0.335574,
    },
    ("on_demand", "intermediate", "articular_bleeding"): {
        "chronic_arthropathy": 0.000654, "minor_bleeding": 0.214475, "articular_bleeding": 0.721893, "life_treating_bleeding": 0.056751,
        "inhibitor": 0.006227,
    },
    ("on_demand", "intermediate", "surgery"): {"inhibitor": 1.0},
    ("on_demand", "end", "joint_replacement"): {"severe_arthropathy": 0.95, "minor_bleeding": 0.04586, "inhibitor": 0.00414},
    ("prophylaxis", "early", "alive_wo_arthropathy"): {
        "alive_wo_arthropathy": 0.604535, "minor_bleeding": 0.050639, "articular_bleeding": 0.319043, "life_treating_bleeding": 0.01525,
        "inhibitor": 0.010093, "chronic_arthropathy": 0.000441,
    },
    ("prophylaxis", "end", "severe_arthropathy"): {
        "severe_arthropathy": 0.915849, "minor_bleeding": 0.010788, "articular_bleeding": 0.067965, "life_treating_bleeding": 0.003249,
        "inhibitor": 0.00215,
    },
    ("prophylaxis", "end", "inhibitor"): {"inhibitor": 0.9915, "minor_bleeding": 0.0085},
    ("prophylaxis", "end", "death"): {"death": 1.0},
}


def test_golden_transition_rows(spark):
    fixed, states = _fixed(spark)
    got = {}
    for r in fixed.filter("prob > 0").collect():
        got.setdefault((r.regime, r.stage, r.from_state), {})[r.to_state] = r.prob
    for key, row in GOLDEN.items():
        assert got[key] == pytest.approx(row, abs=1.5e-6), key
    assert matrix.matrix_violations(fixed, states, ["regime", "stage"]).isEmpty()
    matrix.assert_valid(fixed, states, ["regime", "stage"])


def test_violations(spark):
    states = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "scenario string, ord int, state string")
    bad = spark.createDataFrame([("s", "a", "a", 0.5), ("s", "a", "z", 0.6)], "scenario string, from_state string, to_state string, prob double")
    found = {(r.state, r.problem) for r in matrix.matrix_violations(bad, states, ["scenario"]).collect()}
    assert found == {("a", "sum"), ("z", "unknown"), ("b", "missing")}
    with pytest.raises(ValueError, match="transition table"):
        matrix.assert_valid(bad, states, ["scenario"])


def test_wide_and_back(spark):
    weather = {"Sunny": (0.7, 0.2, 0.1), "Cloudy": (0.4, 0.4, 0.2), "Rainy": (0.2, 0.4, 0.4)}
    long = spark.createDataFrame(
        [("w", a, b, p) for a, ps in weather.items() for b, p in zip(weather, ps)], "scenario string, from_state string, to_state string, prob double"
    )
    wide = sinks.wide_matrix(long, list(weather)).withColumnRenamed("from_state", "States").drop("scenario").withColumn("SUM", F.lit(1.0))
    back = tables.read_wide_matrix(wide, "w")
    assert {(r.from_state, r.to_state): r.prob for r in back.collect()} == {(a, b): p for a, ps in weather.items() for b, p in zip(weather, ps)}
    states = spark.createDataFrame([("w", k, s) for k, s in enumerate(weather)], "scenario string, ord int, state string")
    assert matrix.stored_or_new(long, None, states) is long


def _runs(spark, runs):
    rows = [("s", k, step, s, 1.0, 2.0) for k, path in enumerate(runs) for step, s in enumerate(path)]
    return spark.createDataFrame(rows, "scenario string, run_id long, step int, state string, dose double, cost double")


def test_path_aggregates(spark):
    n, i, j, m = dim.NO_BLEED, dim.INHIBITOR, dim.MAJOR, dim.MINOR
    p = _runs(spark, [[j, j, i, i, n, i], [n], [i, m]])
    r = paths.event_rates(p, ["scenario"], F.lit(1.0).cast("double") + F.min("run_id") * 0).first()
    assert (r.n_runs, r.abr, r.ajbr) == (3, pytest.approx(2 / 3), pytest.approx(1 / 3))
    s = {(x.run_id, x.step): x.streak for x in paths.streaks(p, ["scenario"]).collect()}
    assert [s[0, k] for k in range(6)] == [0, 0, 1, 2, 0, 1] and s[2, 0] == 1 and s[2, 1] == 0
    stages = spark.createDataFrame([("s", x) for x in (n, i, dim.CHRONIC)], "scenario string, state string")
    got = {x.state: (x.percent, x.n_visits) for x in paths.successors(p, ["scenario"], stages).collect()}
    assert got == {n: (100.0, 3), dim.CHRONIC: (0.0, 3)}
    shares = paths.state_shares(p, ["scenario"], [n, i, j, m])
    total = {x.step: x.t for x in shares.groupBy("step").agg(F.sum("share").alias("t")).collect()}
    assert total[0] == pytest.approx(1) and len(total) == 6
    assert paths.mean_totals(p, ["scenario"]).first().mean_dose == 3.0
    assert paths.first_steps(p, ["scenario"]).count() == 5


def test_no_tally_gives_zeros(spark):
    stages = spark.createDataFrame([("s", dim.NO_BLEED)], "scenario string, state string")
    r = paths.successors(_runs(spark, [[dim.MINOR, dim.MINOR]]), ["scenario"], stages).first()
    assert (r.percent, r.n_visits) == (0.0, 0)


def test_moving_average_of_constant(spark):
    df = spark.createDataFrame([("s", "x", k, 0.25) for k in range(20)], "scenario string, state string, step int, share double")
    got = paths.moving_average(df, ["scenario"], "share").collect()
    assert len(got) == 8 and all(r.moving == 0.25 for r in got) and min(r.step for r in got) == 12


def test_rewards_step_offset(spark):
    p = _runs(spark, [["minor", "MAJOR", "lt_bleeding"]])
    seen = {o: paths.add_rewards(p, {"r": lambda step, state: step}, o).orderBy("step").collect() for o in ("natural", "reference")}
    assert [r.r for r in seen["natural"]] == [0, 1, 2] and [r.r for r in seen["reference"]] == [0, 0, 1]
    got = paths.add_rewards(p, {"a": paths.on_demand_consumption, "b": paths.prophylaxis_consumption}).orderBy("step").first()
    assert got.a == pytest.approx(3.7 * 25) and got.b == pytest.approx(3.7 * 75)
    t = paths.reward_totals(paths.add_rewards(p, {"r": lambda step, state: F.lit(2.0)}), ["scenario"], "r").first()
    assert (t.total, t.per_step, t.per_year) == (6.0, 2.0, pytest.approx(104))


def test_doses(spark):
    rows = [("on_demand", dim.MAJOR, 52), ("on_demand", dim.LIFE_THREATENING, 52), ("on_demand", dim.NO_BLEED, 52), ("prophylaxis", dim.INHIBITOR, 52)]
    p = spark.createDataFrame(rows, "regime string, state string, step int")
    got = {r.state: (r.dose, r.cost) for r in paths.with_doses(p, dim.treatments(spark)).collect()}
    assert got[dim.MAJOR] == (150.0, 150.0 * 58000)
    assert got[dim.LIFE_THREATENING][0] == pytest.approx(38.4444444 * 6 * 3, abs=0.01)
    assert got[dim.NO_BLEED] == (0.0, 0.0)
    assert got[dim.INHIBITOR][0] == pytest.approx(27.1666667 * 6, abs=0.01)


def test_long_paths(spark):
    df = spark.createDataFrame([("s", 1, ["a", "b"], [1.0, 2.0], [3.0, 4.0])], "scenario string, run_id long, state_path array<string>, weekly_doses array<double>, weekly_costs array<double>")
    assert [tuple(r) for r in paths.long_paths(df).orderBy("step").collect()] == [("s", 1, 0, "a", 1.0, 3.0), ("s", 1, 1, "b", 2.0, 4.0)]


def test_sensitivity_of_a_sum(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.random((4000, 2)), rng.random((4000, 2))
    y = lambda x: 2 * x[:, 0] + x[:, 1]
    blocks = {"A": a, "B": b, "AB_1": np.column_stack([b[:, 0], a[:, 1]]), "AB_2": np.column_stack([a[:, 0], b[:, 1]])}
    rows = [(k, n, float(v)) for n, x in blocks.items() for k, v in enumerate(y(x))]
    got = {r.input: (r.s1, r.st) for r in sensitivity.sobol_indices(spark.createDataFrame(rows, "base_id long, block string, y double"), 2).collect()}
    assert got[1] == pytest.approx((0.8, 0.8), abs=0.08) and got[2] == pytest.approx((0.2, 0.2), abs=0.08)


def test_sensitivity_pairs_rows_over_the_whole_table(spark):
    cells = [(o, n, float(o), float(n), float(o)) for o in range(400) for n in range(1, 5)]
    rows = spark.createDataFrame(cells, "l_orderkey long, l_linenumber int, x1 double, x2 double, x3 double")
    got = share_queries.paired_rows(rows).collect()
    every = sorted((o, n) for o, n, *_ in cells)
    assert sorted(r.k for r in got) == list(range(len(cells)))
    assert sorted((r.a1, r.a2) for r in got) == sorted((r.b1, r.b2) for r in got) == every
    assert sum(r.a1 == r.b1 for r in got) < 0.05 * len(got)
