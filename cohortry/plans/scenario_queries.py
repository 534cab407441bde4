"""Transition matrices of every regime and stage, and their stored table, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import matrix, paths
from cohortry.plans.path_queries import _PATHS, _paths
from cohortry.plans.path_queries import _RATES as _FIXED_RATES
from cohortry.sources import dimensions as dim
from cohortry.sources import scenarios

KEYS = ["regime", "stage"]
RATES = ["abr", "ajbr", "albr", "eabr", "inhibitor_risk", "progression_risk"]


def regime_rates(spark: SparkSession, d: str) -> DataFrame:
    """The fixed regimes' rates; ``measured``, the events a year of all runs; and ``harsh``, a quarter of these bleeds in
    all with twice as many of each kind, which the weekly rules have to scale down."""
    p = _paths(spark, d)
    n = lambda *s: F.count(F.when(F.col("state").isin(*s), 1)) * 52 / F.count("*")
    seen = p.agg(n(*dim.BLEEDING).alias("abr"), n(dim.MAJOR).alias("ajbr"), n(dim.LIFE_THREATENING).alias("albr"), n(dim.MINOR).alias("eabr"))
    kinds = F.array(*[
        F.struct(F.lit(name).alias("regime"), *[(F.col(c) * k).alias(c) for c, k in zip(RATES, (whole, part, part, part))])
        for name, whole, part in (("measured", 1.0, 1.0), ("harsh", 0.25, 2.0))
    ])
    both = seen.select(F.explode(kinds).alias("r")).select(
        "r.*", F.lit(dim.INHIBITOR_RISK["on_demand"]).alias("inhibitor_risk"), F.lit(dim.PROGRESSION_RISK["on_demand"]).alias("progression_risk")
    )
    return dim.treatments(spark).select("regime", *RATES).unionByName(both)


def _states(spark: SparkSession) -> DataFrame:
    names = spark.createDataFrame([(r,) for r in ("on_demand", "prophylaxis", "measured", "harsh")], "regime string")
    return dim.stage_states(spark).crossJoin(F.broadcast(names))


def _matrices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dense tables of all scenarios before and after their rows are repaired."""
    grid = matrix.dense_grid(dim.transition_rules(spark, regime_rates(spark, d)), _states(spark), KEYS)
    return grid, matrix.normalise_rows(grid, KEYS, matrix.repair_policy(spark))


def scenario_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Every regime's matrix of every stage, and how many moves of the runs it expects in each cell."""
    _, fixed = _matrices(spark, d)
    moves = paths.moves(_paths(spark, d), ["regime"]).groupBy("from_state").agg(F.count("*").alias("n"))
    out = fixed.join(moves, "from_state", "left")
    expected = F.round(F.col("prob") * F.coalesce("n", F.lit(0)), 5)
    return out.select(*KEYS, "from_state", "to_state", F.round("prob", 8).alias("prob"), expected.alias("expected"))


def stored_matrices(spark: SparkSession, d: str) -> DataFrame:
    """The stored table brought up to date. Stored are the unrepaired tables of both fixed regimes, that of the last
    stage without one of its states; the other regimes aren't stored."""
    grid, fixed = _matrices(spark, d)
    lacks = (F.col("stage") == "end") & ((F.col("from_state") == dim.SURGERY) | (F.col("to_state") == dim.SURGERY))
    stored = grid.filter(F.col("regime").isin("on_demand", "prophylaxis") & ~lacks)
    out = scenarios.kept_or_new(stored, fixed, _states(spark), KEYS)
    return out.select(*KEYS, "from_state", "to_state", F.round("prob", 8).alias("prob"), "status")


_STAGES = ", ".join(f"('{stage}', '{state}')" for stage, states in dim.STAGES.items() for state in states)
_SCENARIOS = f"""
{_PATHS}, {_FIXED_RATES},
seen AS (SELECT count(*) FILTER (state IN ('minor_bleeding', 'articular_bleeding', 'life_treating_bleeding')) * 52 / count(*) AS abr, count(*) FILTER (state = 'articular_bleeding') * 52 / count(*) AS ajbr,
    count(*) FILTER (state = 'life_treating_bleeding') * 52 / count(*) AS albr, count(*) FILTER (state = 'minor_bleeding') * 52 / count(*) AS eabr FROM paths),
every AS (SELECT regime, abr, ajbr, albr, eabr, progress, inhibit FROM tr
    UNION ALL SELECT 'measured', abr, ajbr, albr, eabr, 0.000435, 0.00414 FROM seen
    UNION ALL SELECT 'harsh', abr * 0.25, ajbr * 2, albr * 2, eabr * 2, 0.000435, 0.00414 FROM seen),
st(stage, state) AS (VALUES {_STAGES}),
w AS (SELECT regime, stage, 1 - exp(-greatest(52 - abr, 0) / 52) AS stay, 1 - exp(-eabr / 52) AS mi, 1 - exp(-ajbr / 52) AS ma, 1 - exp(-albr / 52) AS lt, progress, inhibit,
    (SELECT count(*) FROM st WHERE st.stage = x.stage AND state = 'chronic_arthropathy') AS c FROM every, (SELECT DISTINCT stage FROM st) x),
z AS (SELECT *, CASE WHEN mi + ma + lt + progress * c + inhibit > 1 - stay THEN (1 - stay) / (mi + ma + lt + progress * c + inhibit) ELSE 1.0 END AS k FROM w),
u AS (SELECT regime, stage, stay, mi * k AS mi, ma * k AS ma, lt * k AS lt, progress * k AS progress, inhibit * k AS inhibit FROM z),
bleed AS (SELECT regime, stage, unnest(['alive_wo_arthropathy', 'minor_bleeding', 'articular_bleeding', 'life_treating_bleeding', 'chronic_arthropathy', 'inhibitor']) AS t,
    unnest([stay, mi, ma, lt, progress, inhibit]) AS prob FROM u),
rules AS (SELECT regime, stage, f, t, prob FROM bleed, (VALUES ('alive_wo_arthropathy'), ('minor_bleeding'), ('articular_bleeding')) x(f)
    UNION ALL SELECT regime, stage, 'life_treating_bleeding', unnest(['alive_wo_arthropathy', 'death', 'inhibitor']), unnest([0.95, 2.4e-5, inhibit]) FROM u
    UNION ALL SELECT regime, stage, 'chronic_arthropathy', CASE t WHEN 'chronic_arthropathy' THEN 'severe_arthropathy' ELSE t END, prob FROM bleed WHERE t <> 'alive_wo_arthropathy'
    UNION ALL SELECT regime, stage, 'severe_arthropathy', t, prob FROM bleed WHERE t NOT IN ('alive_wo_arthropathy', 'chronic_arthropathy')
    UNION ALL SELECT regime, stage, 'surgery', unnest(['alive_wo_arthropathy', 'inhibitor']), unnest([0.95, inhibit]) FROM u
    UNION ALL SELECT regime, stage, 'joint_replacement', unnest(['severe_arthropathy', 'inhibitor']), unnest([0.95, inhibit]) FROM u
    UNION ALL SELECT regime, stage, 'inhibitor', unnest(['inhibitor', 'minor_bleeding']), unnest([1 - 0.0085, 0.0085]) FROM u
    UNION ALL SELECT regime, stage, 'death', 'death', 1.0 FROM u),
dn AS (SELECT e.regime, a.stage, a.state AS from_state, b.state AS to_state, coalesce(r.prob, 0.0)::DOUBLE AS prob FROM every e, st a JOIN st b ON a.stage = b.stage
    LEFT JOIN rules r ON r.regime = e.regime AND r.stage = a.stage AND r.f = a.state AND r.t = b.state),
rs AS (SELECT *, sum(prob) OVER r AS s, coalesce(sum(prob) FILTER (to_state = 'alive_wo_arthropathy') OVER r, 0) AS k, coalesce(sum(prob) FILTER (to_state <> 'alive_wo_arthropathy') OVER r, 0) AS o,
    CASE WHEN count(*) FILTER (to_state = 'chronic_arthropathy') OVER r > 0 THEN 'chronic_arthropathy' ELSE 'minor_bleeding' END AS rest,
    from_state IN ('alive_wo_arthropathy', 'minor_bleeding', 'articular_bleeding', 'surgery') AS keep,
    CASE WHEN from_state IN ('chronic_arthropathy', 'severe_arthropathy', 'inhibitor') THEN from_state ELSE 'minor_bleeding' END AS target
    FROM dn WINDOW r AS (PARTITION BY regime, stage, from_state)),
fixed AS (SELECT regime, stage, from_state, to_state, CASE WHEN abs(s - 1) <= 1e-6 THEN prob
    WHEN keep THEN CASE WHEN to_state = 'alive_wo_arthropathy' THEN prob WHEN o > 0 THEN prob * (1 - k) / o WHEN to_state = rest THEN 1 - k ELSE prob END
    WHEN s > 1 THEN prob / s WHEN to_state = target THEN prob + 1 - s ELSE prob END AS prob FROM rs)
"""
SCENARIO_MATRICES = f"""
WITH {_SCENARIOS}, mv AS (SELECT state AS f, lead(state) OVER (PARTITION BY regime, run_id ORDER BY step) AS t FROM paths),
n AS (SELECT f AS from_state, count(*) AS n FROM mv WHERE t IS NOT NULL GROUP BY f)
SELECT regime, stage, from_state, to_state, round(prob, 8) AS prob, round(prob * coalesce(n, 0), 5) AS expected FROM fixed LEFT JOIN n USING (from_state)
"""
STORED_MATRICES = f"""
WITH {_SCENARIOS}
SELECT regime, stage, from_state, to_state, round(prob, 8) AS prob, 'stored' AS status FROM dn WHERE regime IN ('on_demand', 'prophylaxis') AND stage <> 'end'
UNION ALL SELECT regime, stage, from_state, to_state, round(prob, 8), 'stale' FROM fixed WHERE regime IN ('on_demand', 'prophylaxis') AND stage = 'end'
UNION ALL SELECT regime, stage, from_state, to_state, round(prob, 8), 'missing' FROM fixed WHERE regime IN ('measured', 'harsh')
"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((scenario_matrices, SCENARIO_MATRICES), (stored_matrices, STORED_MATRICES))}
