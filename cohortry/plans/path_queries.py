"""Transition-table and state-path queries on the driver's tables, with their SQL.

Events are read as paths: run = user, step = rank in time from 0, state by event type, regime by the user's parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.operators import matrix, paths
from cohortry.operators.filters import in_states
from cohortry.sources import dimensions as dim
from cohortry.sources import html_fields, scenarios, sinks, tables

EVENT_STATES = {
    "view": dim.NO_BLEED, "click": dim.MINOR, "error": dim.MAJOR, "purchase": dim.LIFE_THREATENING, "signup": dim.INHIBITOR,
}
KEYS = ["regime", "stage"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    state = F.lit(None).cast("string")
    for kind, name in EVENT_STATES.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "on_demand").otherwise("prophylaxis").alias("regime"), F.lit("early").alias("stage"),
        F.col("user_id").alias("run_id"), step.alias("step"), state.alias("state"),
    )


_PATHS = """
paths AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'on_demand' ELSE 'prophylaxis' END AS regime, 'early' AS stage, user_id AS run_id,
    (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS step,
    CASE event_type WHEN 'view' THEN 'alive_wo_arthropathy' WHEN 'click' THEN 'minor_bleeding' WHEN 'error' THEN 'articular_bleeding'
         WHEN 'purchase' THEN 'life_treating_bleeding' WHEN 'signup' THEN 'inhibitor' END AS state FROM events)
"""
_WEIGHT = """round_even(CASE WHEN step <= 104 THEN greatest(3.5, 12 / (1 + exp(-0.05 * (step - 52)))) WHEN step <= 624 THEN 12 + (step - 104) * (28 / 520)
    WHEN step <= 936 THEN 40 + (step - 624) * (30 / 312) WHEN step <= 3380 THEN 70 + 5 * sin(step / 520) ELSE 70 - (least(step, 3796) - 3380) * 5 / 416 END::DOUBLE, 2)"""
_DOSES = f"""
w AS (SELECT *, {_WEIGHT} AS kg FROM paths),
q AS (SELECT *, CASE state WHEN 'articular_bleeding' THEN 25.0 * kg * 1 WHEN 'minor_bleeding' THEN (0.05 * 31.5 + 0.1 * 25.0) / 0.15 * kg * 1
      WHEN 'inhibitor' THEN (0.05 * 31.5 + 0.1 * 25.0) / 0.15 * kg * 1
      WHEN 'life_treating_bleeding' THEN (0.015 * 32.0 + 0.01 * 35.0 + 0.02 * 45.0) / 0.045 * kg * 3 ELSE 0.0 END::DOUBLE AS raw FROM w),
doses AS (SELECT regime, stage, run_id, step, state, round_even(raw, 6) AS dose, round_even(raw * 58000, 6) AS cost FROM q)
"""


def _dosed(spark: SparkSession, d: str) -> DataFrame:
    return paths.with_doses(_paths(spark, d), dim.treatments(spark), digits=6)  # two digits would often be ties


def path_doses(spark: SparkSession, d: str) -> DataFrame:
    """Total dose and cost by state and step."""
    g = _dosed(spark, d).groupBy("regime", "state", "step")
    return g.agg(F.round(F.sum("dose"), 6).alias("dose"), F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("n"))


PATH_DOSES = f"WITH {_PATHS}, {_DOSES} SELECT regime, state, step, round(sum(dose), 6) AS dose, round(sum(cost), 2) AS cost, count(*) AS n FROM doses GROUP BY ALL"


def run_mean_totals(spark: SparkSession, d: str) -> DataFrame:
    m = paths.mean_totals(_dosed(spark, d), KEYS)
    return m.select(*KEYS, F.round("mean_dose", 6).alias("mean_dose"), F.round("mean_cost", 3).alias("mean_cost"))


RUN_MEAN_TOTALS = f"""
WITH {_PATHS}, {_DOSES}, r AS (SELECT regime, stage, run_id, sum(dose) AS d, sum(cost) AS c FROM doses GROUP BY ALL)
SELECT regime, stage, round(avg(d), 6) AS mean_dose, round(avg(c), 3) AS mean_cost FROM r GROUP BY ALL
"""


def bleeding_rates(spark: SparkSession, d: str) -> DataFrame:
    r = paths.event_rates(_paths(spark, d), KEYS, F.count("*") / 52)
    return r.select(*KEYS, F.round("abr", 8).alias("abr"), F.round("ajbr", 8).alias("ajbr"), "n_runs")


BLEEDING_RATES = f"""
WITH {_PATHS}, r AS (SELECT regime, stage, run_id, sum((step >= 1 AND state IN ('minor_bleeding', 'articular_bleeding', 'life_treating_bleeding'))::INT) / (count(*) / 52) AS a,
    sum((step >= 1 AND state = 'articular_bleeding')::INT) / (count(*) / 52) AS j FROM paths GROUP BY ALL)
SELECT regime, stage, round(avg(a), 8) AS abr, round(avg(j), 8) AS ajbr, count(*) AS n_runs FROM r GROUP BY ALL
"""


def reward_totals(spark: SparkSession, d: str) -> DataFrame:
    """Weekly consumption of each regime, scored with the step before as the plain walk does."""
    p = _paths(spark, d)
    short = F.when(F.col("state") == dim.MINOR, "Minor").when(F.col("state") == dim.MAJOR, "MAJOR").when(
        F.col("state") == dim.LIFE_THREATENING, "lt_bleeding"
    ).otherwise(F.col("state"))
    p = paths.add_rewards(
        p.withColumn("state", short), {"demand": paths.on_demand_consumption, "prophylaxis": paths.prophylaxis_consumption}, "reference"
    )
    mine = p.withColumn("reward", F.when(F.col("regime") == "on_demand", F.col("demand")).otherwise(F.col("prophylaxis")))
    t = paths.reward_totals(mine, ["regime"], "reward")
    return t.select("regime", "run_id", "n_steps", *[F.round(c, 8).alias(c) for c in ("total", "per_step", "per_year")])


REWARD_TOTALS = f"""
WITH {_PATHS}, g AS (SELECT *, round_even((80.5 * exp(-3.08 * exp(-0.00255 * greatest(step - 1, 0))))::DOUBLE, 2) AS kg FROM paths),
r AS (SELECT regime, run_id, kg * (CASE state WHEN 'minor_bleeding' THEN 25 WHEN 'articular_bleeding' THEN 90 WHEN 'life_treating_bleeding' THEN 250 ELSE 0 END
      + CASE WHEN regime = 'prophylaxis' THEN 50 ELSE 0 END) AS reward FROM g)
SELECT regime, run_id, count(*) AS n_steps, round(sum(reward), 8) AS total, round(sum(reward) / count(*), 8) AS per_step, round(sum(reward) / (count(*) / 52), 8) AS per_year
FROM r GROUP BY ALL
"""

_STATES = [dim.NO_BLEED, dim.MINOR, dim.MAJOR, dim.LIFE_THREATENING, dim.INHIBITOR, dim.DEATH]
_SHARES = f"""
n AS (SELECT regime, stage, count(DISTINCT run_id) AS runs, max(step) AS last FROM paths GROUP BY ALL),
g AS (SELECT regime, stage, runs, unnest(range(0, last + 1))::INT AS step FROM n),
gs AS (SELECT g.*, state FROM g, (SELECT unnest(['{"', '".join(_STATES)}']) AS state)),
c AS (SELECT regime, stage, step, state, count(*) AS n FROM paths GROUP BY ALL),
shares AS (SELECT regime, stage, step, state, coalesce(n, 0) / runs AS share FROM gs LEFT JOIN c USING (regime, stage, step, state))
"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return paths.state_shares(_paths(spark, d), KEYS, _STATES)


def state_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).withColumn("share", F.round("share", 9))


STATE_SHARES = f"WITH {_PATHS}, {_SHARES} SELECT regime, stage, step, state, round(share, 9) AS share FROM shares"


def moving_state_shares(spark: SparkSession, d: str) -> DataFrame:
    return paths.moving_average(_shares(spark, d), KEYS, "share").withColumn("moving", F.round("moving", 8))


MOVING_STATE_SHARES = f"""
WITH {_PATHS}, {_SHARES}, m AS (SELECT regime, stage, step, state, avg(share) OVER w AS moving, count(*) OVER w AS n FROM shares
    WINDOW w AS (PARTITION BY regime, stage, state ORDER BY step ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT regime, stage, step, state, round(moving, 8) AS moving FROM m WHERE n = 13
"""


def inhibitor_streaks(spark: SparkSession, d: str) -> DataFrame:
    s = paths.streaks(_paths(spark, d), KEYS)
    return s.groupBy("regime", "run_id").agg(F.max("streak").alias("longest"), F.sum((F.col("streak") == 1).cast("long")).alias("stays"))


INHIBITOR_STREAKS = f"""
WITH {_PATHS}, i AS (SELECT *, sum((state IS DISTINCT FROM 'inhibitor')::INT) OVER (PARTITION BY run_id ORDER BY step) AS isle FROM paths),
s AS (SELECT regime, run_id, isle, sum((state = 'inhibitor')::INT) AS n FROM i GROUP BY ALL)
SELECT regime, run_id, max(coalesce(n, 0))::BIGINT AS longest, sum((n > 0)::INT)::BIGINT AS stays FROM s GROUP BY ALL
"""


def after_inhibitor(spark: SparkSession, d: str) -> DataFrame:
    stages = dim.stage_states(spark).select("stage", "state").crossJoin(F.broadcast(spark.createDataFrame([("on_demand",), ("prophylaxis",)], "regime string")))
    return paths.successors(_paths(spark, d), KEYS, stages).withColumn("percent", F.round("percent", 8))


AFTER_INHIBITOR = f"""
WITH {_PATHS}, l AS (SELECT *, lead(state) OVER (PARTITION BY run_id ORDER BY step) AS nxt FROM paths),
v AS (SELECT * FROM l WHERE state = 'inhibitor' AND nxt IS NOT NULL),
g AS (SELECT DISTINCT regime, stage FROM paths),
s AS (SELECT * FROM g, (SELECT unnest(['alive_wo_arthropathy', 'chronic_arthropathy']) AS state)),
n AS (SELECT s.*, (SELECT count(*) FROM v WHERE v.regime = s.regime AND nxt = s.state) AS n, (SELECT count(*) FROM v WHERE v.regime = s.regime) AS n_visits FROM s)
SELECT regime, stage, state, CASE WHEN sum(n) OVER p > 0 THEN round(100 * n / sum(n) OVER p, 8) ELSE 0.0 END AS percent, n_visits FROM n WINDOW p AS (PARTITION BY regime, stage)
"""


def first_path_steps(spark: SparkSession, d: str) -> DataFrame:
    return paths.first_steps(_paths(spark, d), KEYS)


FIRST_PATH_STEPS = f"WITH {_PATHS} SELECT regime, stage, run_id, step, state FROM paths QUALIFY run_id = min(run_id) OVER (PARTITION BY regime, stage) AND step < 5"


def regimes_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    both = paths.side_by_side(_shares(spark, d), ["stage", "step", "state"], "share")
    return both.select("stage", "step", "state", F.round("on_demand", 9).alias("on_demand"), F.round("prophylaxis", 9).alias("prophylaxis"))


REGIMES_SIDE_BY_SIDE = f"""
WITH {_PATHS}, {_SHARES} SELECT stage, step, state, round(max(share) FILTER (regime = 'on_demand'), 9) AS on_demand,
    round(max(share) FILTER (regime = 'prophylaxis'), 9) AS prophylaxis FROM shares GROUP BY ALL
"""


def bleeding_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps in a bleeding state, by a semi-join with the stage dimension cut to such states."""
    bleeds = dim.stage_states(spark).filter(F.col("state").isin(*dim.BLEEDING))
    return in_states(_paths(spark, d), bleeds).groupBy("regime", "state").agg(F.count("*").alias("n"))


BLEEDING_STEPS = f"WITH {_PATHS} SELECT regime, state, count(*) AS n FROM paths WHERE state IN ('minor_bleeding', 'articular_bleeding', 'life_treating_bleeding') GROUP BY ALL"


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Observed transitions of each regime as probabilities of the from-state, some rows weighted up or down."""
    moves = paths.moves(_paths(spark, d), ["regime"])
    n = moves.groupBy("regime", "stage", "from_state", "to_state").agg(F.count("*").alias("n"))
    total = Window.partitionBy("regime", "stage", "from_state")
    weight = F.when(F.col("from_state") == dim.MINOR, 0.8).when(F.col("from_state") == dim.LIFE_THREATENING, 1.3).when(F.col("from_state") == dim.INHIBITOR, 0.6).otherwise(1.0)
    return n.withColumn("prob", F.col("n") / F.sum("n").over(total) * weight)


_OBSERVED = f"""
{_PATHS}, mv AS (SELECT regime, stage, state AS from_state, lead(state) OVER (PARTITION BY regime, run_id ORDER BY step) AS to_state FROM paths),
mc AS (SELECT regime, stage, from_state, to_state, count(*) AS n FROM mv WHERE to_state IS NOT NULL GROUP BY ALL),
obs AS (SELECT regime, stage, from_state, to_state, n / sum(n) OVER (PARTITION BY regime, stage, from_state)
    * CASE from_state WHEN 'minor_bleeding' THEN 0.8 WHEN 'life_treating_bleeding' THEN 1.3 WHEN 'inhibitor' THEN 0.6 ELSE 1.0 END AS prob FROM mc),
st(ord, state) AS (VALUES (0, 'alive_wo_arthropathy'), (1, 'minor_bleeding'), (2, 'articular_bleeding'), (3, 'life_treating_bleeding'), (4, 'surgery'),
    (5, 'inhibitor'), (6, 'death'), (7, 'chronic_arthropathy')),
rg AS (SELECT DISTINCT regime, stage FROM paths),
gr AS (SELECT regime, stage, a.state AS from_state, b.state AS to_state FROM rg, st a, st b),
dn AS (SELECT gr.*, coalesce(prob, 0.0)::DOUBLE AS prob FROM gr LEFT JOIN obs USING (regime, stage, from_state, to_state))
"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    two = F.broadcast(spark.createDataFrame([("on_demand",), ("prophylaxis",)], "regime string"))
    states = dim.stage_states(spark).filter("stage = 'early'").crossJoin(two)
    return matrix.dense_grid(_observed(spark, d), states, KEYS)


def transition_row_sums(spark: SparkSession, d: str) -> DataFrame:
    return matrix.row_sums(_grid(spark, d), KEYS).withColumn("row_sum", F.round("row_sum", 9))


TRANSITION_ROW_SUMS = f"WITH {_OBSERVED} SELECT regime, stage, from_state, round(sum(prob), 9) AS row_sum FROM dn GROUP BY ALL"


def repaired_transitions(spark: SparkSession, d: str) -> DataFrame:
    out = matrix.normalise_rows(_grid(spark, d), KEYS, matrix.repair_policy(spark))
    return out.select(*KEYS, "from_state", "to_state", F.round("prob", 8).alias("prob"))


_REPAIRED = f"""
{_OBSERVED}, rs AS (SELECT *, sum(prob) OVER r AS s, CASE WHEN from_state IN ('alive_wo_arthropathy', 'minor_bleeding', 'articular_bleeding', 'surgery') THEN 'keep' ELSE 'gap' END AS policy,
    sum(prob) FILTER (to_state = 'alive_wo_arthropathy') OVER r AS k, coalesce(sum(prob) FILTER (to_state <> 'alive_wo_arthropathy') OVER r, 0) AS o,
    CASE WHEN from_state IN ('chronic_arthropathy', 'severe_arthropathy', 'inhibitor') THEN from_state ELSE 'minor_bleeding' END AS target
    FROM dn WINDOW r AS (PARTITION BY regime, stage, from_state)),
fixed AS (SELECT regime, stage, from_state, to_state, CASE WHEN abs(s - 1) <= 1e-6 THEN prob
    WHEN policy = 'keep' THEN CASE WHEN to_state = 'alive_wo_arthropathy' THEN prob WHEN o > 0 THEN prob * (1 - k) / o WHEN to_state = 'chronic_arthropathy' THEN 1 - k ELSE prob END
    WHEN s > 1 THEN prob / s WHEN to_state = target THEN prob + 1 - s ELSE prob END AS prob FROM rs)
"""
REPAIRED_TRANSITIONS = f"WITH {_REPAIRED} SELECT regime, stage, from_state, to_state, round(prob, 8) AS prob FROM fixed"


def transition_violations(spark: SparkSession, d: str) -> DataFrame:
    two = F.broadcast(spark.createDataFrame([("on_demand",), ("prophylaxis",)], "regime string"))
    states = dim.stage_states(spark).filter("stage = 'early'").crossJoin(two)
    return matrix.matrix_violations(_observed(spark, d), states, KEYS)


TRANSITION_VIOLATIONS = f"""
WITH {_OBSERVED}, r AS (SELECT regime, stage, from_state AS state, sum(prob) AS s, count(*) AS n FROM obs GROUP BY ALL)
SELECT regime, stage, state, 'sum' AS problem FROM r WHERE abs(s - 1) > 1e-5
UNION ALL SELECT regime, stage, state, 'cells' FROM r WHERE n <> 8
UNION ALL SELECT rg.regime, rg.stage, st.state, 'missing' FROM rg, st WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.regime = rg.regime AND r.state = st.state)
"""


def wide_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The repaired table, wide, and read back from its wide form, where the sums still are 1."""
    states = dim.STAGES["early"]
    fixed = matrix.normalise_rows(_grid(spark, d), KEYS, matrix.repair_policy(spark))
    fixed = fixed.filter("regime = 'on_demand'").select(F.col("regime").alias("scenario"), "from_state", "to_state", "prob")
    wide = sinks.wide_matrix(fixed, states).withColumnRenamed("from_state", "States").drop("scenario").withColumn("SUM", F.lit(1.0))
    back = tables.read_wide_matrix(wide, "on_demand")
    return back.select("scenario", "ord", "from_state", "to_state", F.round("prob", 8).alias("prob"))


WIDE_TRANSITIONS = f"""
WITH {_REPAIRED} SELECT regime AS scenario, ord, from_state, to_state, round(prob, 8) AS prob FROM fixed JOIN st ON from_state = state WHERE regime = 'on_demand'
"""


def start_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the runs' first states as initial probabilities; some are given a name that no stage has, and those of
    one regime are weighted down."""
    p = paths.first_states(_paths(spark, d), KEYS)
    state = F.when(F.col("run_id") % 7 == 0, "unheard_of").otherwise(F.col("state"))
    n = p.groupBy(*KEYS, state.alias("state")).agg(F.count("*").alias("n"))
    weight = F.when(F.col("regime") == "prophylaxis", 0.9).otherwise(1.0)
    initial = n.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS)) * weight)
    two = F.broadcast(spark.createDataFrame([("on_demand",), ("prophylaxis",)], "regime string"))
    states = dim.stage_states(spark).filter("stage = 'early'").crossJoin(two)
    return matrix.initial_violations(initial, states, KEYS)


START_PROBLEMS = f"""
WITH {_PATHS}, f AS (SELECT DISTINCT regime, stage, CASE WHEN run_id % 7 = 0 THEN 'unheard_of' END AS state FROM paths WHERE step = 0)
SELECT DISTINCT regime, stage, NULL::VARCHAR AS state, 'initial' AS problem FROM f WHERE regime = 'prophylaxis'
UNION ALL SELECT regime, stage, state, 'start' FROM f WHERE state IS NOT NULL
"""


def kept_transitions(spark: SparkSession, d: str) -> DataFrame:
    """A stored table that has all states is kept as it is; one that lacks a state is built anew."""
    two = F.broadcast(spark.createDataFrame([("on_demand",), ("prophylaxis",)], "regime string"))
    states = dim.stage_states(spark).filter("stage = 'early'").crossJoin(two)
    grid = _grid(spark, d)
    stored = grid.filter((F.col("regime") == "on_demand") | (F.col("to_state") != dim.SURGERY))
    out = scenarios.kept_or_new(stored, matrix.normalise_rows(grid, KEYS, matrix.repair_policy(spark)), states, KEYS)
    return out.select("regime", "from_state", "to_state", F.round("prob", 8).alias("prob"))


KEPT_TRANSITIONS = f"""
WITH {_REPAIRED} SELECT regime, from_state, to_state, round(prob, 8) AS prob FROM dn WHERE regime = 'on_demand'
UNION ALL SELECT regime, from_state, to_state, round(prob, 8) FROM fixed WHERE regime = 'prophylaxis'
"""


def rule_moves(spark: SparkSession, d: str) -> DataFrame:
    """How many of the observed moves the weekly rules expect in each cell, beside those that were seen."""
    moves = paths.moves(_paths(spark, d), ["regime"])
    seen = moves.groupBy("regime", "stage", "from_state", "to_state").agg(F.count("*").alias("seen"))
    total = moves.groupBy("regime", "stage", "from_state").agg(F.count("*").alias("n"))
    rules = dim.transition_rules(spark).select("regime", "stage", "from_state", "to_state", "prob")
    both = total.join(rules, ["regime", "stage", "from_state"]).join(seen, ["regime", "stage", "from_state", "to_state"], "left")
    return both.select(
        "regime", "from_state", "to_state", F.round("prob", 9).alias("prob"), F.round(F.col("prob") * F.col("n"), 6).alias("expected"),
        F.coalesce("seen", F.lit(0)).alias("seen"),
    )


_RATES = """
tr(regime, abr, ajbr, albr, eabr, progress, inhibit) AS (VALUES
    ('on_demand', 44.0::DOUBLE, 34.0::DOUBLE, round_even(44 * 0.045::DOUBLE, 0), round_even(44 * 0.15::DOUBLE, 0) + 1, 0.000435::DOUBLE, 0.00414::DOUBLE),
    ('prophylaxis', 3.76, 3.66, 3.76::DOUBLE * 0.045, 3.76::DOUBLE * 0.15, 0.0000939, 0.00215))
"""
RULE_MOVES = f"""
WITH {_PATHS}, {_RATES}, mv AS (SELECT regime, state AS f, lead(state) OVER (PARTITION BY regime, run_id ORDER BY step) AS t FROM paths),
n AS (SELECT regime, f, count(*) AS n FROM mv WHERE t IS NOT NULL GROUP BY ALL), seen AS (SELECT regime, f, t, count(*) AS seen FROM mv WHERE t IS NOT NULL GROUP BY ALL),
w AS (SELECT regime, 1 - exp(-greatest(52 - abr, 0) / 52) AS stay, 1 - exp(-eabr / 52) AS mi, 1 - exp(-ajbr / 52) AS ma, 1 - exp(-albr / 52) AS lt, progress, inhibit FROM tr),
bleed AS (SELECT regime, unnest(['alive_wo_arthropathy', 'minor_bleeding', 'articular_bleeding', 'life_treating_bleeding', 'chronic_arthropathy', 'inhibitor']) AS t,
                 unnest([stay, mi, ma, lt, progress, inhibit]) AS prob FROM w),
rules AS (SELECT regime, f, t, prob FROM bleed, (VALUES ('alive_wo_arthropathy'), ('minor_bleeding'), ('articular_bleeding')) x(f)
    UNION ALL SELECT regime, 'life_treating_bleeding', unnest(['alive_wo_arthropathy', 'death', 'inhibitor']), unnest([0.95, 2.4e-5, inhibit]) FROM w
    UNION ALL SELECT regime, 'chronic_arthropathy', t, prob FROM bleed WHERE t NOT IN ('alive_wo_arthropathy', 'chronic_arthropathy')
    UNION ALL SELECT regime, 'surgery', unnest(['alive_wo_arthropathy', 'inhibitor']), unnest([0.95, inhibit]) FROM w
    UNION ALL SELECT regime, 'inhibitor', unnest(['inhibitor', 'minor_bleeding']), unnest([1 - 0.0085, 0.0085]) FROM w
    UNION ALL SELECT regime, 'death', 'death', 1.0 FROM w)
SELECT regime, f AS from_state, t AS to_state, round(prob, 9) AS prob, round(prob * n, 6) AS expected, coalesce(seen, 0) AS seen
FROM n JOIN rules USING (regime, f) LEFT JOIN seen USING (regime, f, t)
"""


def derived_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each regime's derived yearly rates, and how many of the observed bleeds they would make of either kind."""
    bleeds = _paths(spark, d).groupBy("regime").agg(F.count(F.when(F.col("state").isin(*dim.BLEEDING), 1)).alias("bleeds"))
    t = dim.treatments(spark).select("regime", "abr", "albr", "eabr")
    parts = {f"{kind}_bleeds": F.round(F.col("bleeds") * F.col(rate) / F.col("abr"), 6) for kind, rate in (("severe", "albr"), ("outside", "eabr"))}
    out = bleeds.join(F.broadcast(t), "regime").withColumns(parts)
    return out.select("regime", "abr", F.round("albr", 9).alias("albr"), F.round("eabr", 9).alias("eabr"), "bleeds", *parts)


DERIVED_RATES = f"""
WITH {_PATHS}, {_RATES}, b AS (SELECT regime, count(*) FILTER (state IN ('minor_bleeding', 'articular_bleeding', 'life_treating_bleeding')) AS bleeds FROM paths GROUP BY ALL)
SELECT regime, abr, round(albr, 9) AS albr, round(eabr, 9) AS eabr, bleeds, round(bleeds * albr / abr, 6) AS severe_bleeds, round(bleeds * eabr / abr, 6) AS outside_bleeds
FROM b JOIN tr USING (regime)
"""


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title, heading and first link text of each page."""
    html, names = F.col("html"), {"title": "title", "h1": "heading", "a": "link"}
    pages = _t(spark, d, "pages").filter(html_fields.has_tag(html, list(names)))
    return pages.select("page_id", *[html_fields.first_text(html, tag).alias(name) for tag, name in names.items()])


def _first_text(tag: str) -> str:
    """SQL for the text of a page's first element of a tag, as a parser would give it."""
    inner = f"regexp_extract(html, '<{tag}(\\s[^>]*)?>(.*?)</{tag}>', 2, 's')"
    bare = f"regexp_replace({inner}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return f"CASE WHEN regexp_matches(html, '<{tag}(\\s[^>]*)?>') THEN trim({bare}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) ELSE 'N/A' END"


PAGE_TITLES = f"""
SELECT page_id, {_first_text("title")} AS title, {_first_text("h1")} AS heading, {_first_text("a")} AS link FROM pages
WHERE regexp_matches(html, '<(title|h1|a)[\\s>]')
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (path_doses, PATH_DOSES), (run_mean_totals, RUN_MEAN_TOTALS), (bleeding_rates, BLEEDING_RATES),
        (reward_totals, REWARD_TOTALS), (state_shares, STATE_SHARES), (moving_state_shares, MOVING_STATE_SHARES),
        (inhibitor_streaks, INHIBITOR_STREAKS), (after_inhibitor, AFTER_INHIBITOR), (first_path_steps, FIRST_PATH_STEPS),
        (regimes_side_by_side, REGIMES_SIDE_BY_SIDE), (bleeding_steps, BLEEDING_STEPS),
        (transition_row_sums, TRANSITION_ROW_SUMS), (repaired_transitions, REPAIRED_TRANSITIONS),
        (transition_violations, TRANSITION_VIOLATIONS), (wide_transitions, WIDE_TRANSITIONS), (page_titles, PAGE_TITLES),
        (start_problems, START_PROBLEMS), (kept_transitions, KEPT_TRANSITIONS), (rule_moves, RULE_MOVES), (derived_rates, DERIVED_RATES),
    )
}
