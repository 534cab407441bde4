"""Long tables of state paths: (scenario, run_id, step, state, ...), one row for each run and step."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.body import growth_weight, staged_weight
from cohortry.sources.dimensions import BLEEDING, CHRONIC, INHIBITOR, LIFE_THREATENING, MAJOR, MINOR, NO_BLEED, SEVERE

Reward = Callable[[Column, Column], Column]


def run_line(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "run_id").orderBy("step")


def moves(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Each step that has a next one, as from_state and to_state."""
    after = F.lead("state").over(run_line(keys))
    return paths.withColumn("to_state", after).filter("to_state is not null").withColumnRenamed("state", "from_state")


def first_states(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, run and state of each run's smallest step."""
    return paths.groupBy(*keys, "run_id").agg(F.min_by("state", "step").alias("state"))


def with_doses(paths: DataFrame, treatments: DataFrame, digits: int = 2) -> DataFrame:
    """Adds the week's dose and cost by state, regime and weight at age ``step``, both rounded; cost comes from the
    unrounded dose."""
    t = treatments.select(
        "regime", "price_per_unit", *[f"{k}_{c}" for k in ("major", "minor", "lt") for c in ("per_kg", "injections")]
    )
    kinds = F.when(F.col("state") == MAJOR, F.lit("major")).when(F.col("state").isin(MINOR, INHIBITOR), F.lit("minor")).when(
        F.col("state") == LIFE_THREATENING, F.lit("lt")
    )
    per_week = F.lit(0.0)
    for k in ("major", "minor", "lt"):
        per_week = F.when(F.col("_kind") == k, F.col(f"{k}_per_kg") * staged_weight(F.col("step")) * F.col(f"{k}_injections")).otherwise(per_week)
    df = paths.withColumn("_kind", kinds).join(F.broadcast(t), "regime", "left").withColumn("_dose", per_week)
    return df.select(
        *[F.col(c) for c in paths.columns if c not in ("dose", "cost")],
        F.bround("_dose", digits).alias("dose"), F.bround(F.col("_dose") * F.col("price_per_unit"), digits).alias("cost"),
    )


def on_demand_consumption(step: Column, state: Column) -> Column:
    """Weight times 25, 90 or 250 for a minor, major or life-threatening bleed, else 0; any case."""
    s = F.lower(state)
    per_kg = F.when(s == "minor", 25).when(s == "major", 90).when(s == "lt_bleeding", 250).otherwise(0)
    return growth_weight(step) * per_kg


def prophylaxis_consumption(step: Column, state: Column) -> Column:
    return on_demand_consumption(step, state) + growth_weight(step) * 50


def plain_reward(score: Callable[[int, str], float]) -> Reward:
    """A reward from a plain function of step and state, for what built-in functions can't say; it runs in Arrow batches,
    once for each different pair of a batch."""

    @F.pandas_udf("double")
    def scored(step: pd.Series, state: pd.Series) -> pd.Series:
        pairs = list(zip(step, state, strict=True))
        known = {p: float(score(*p)) for p in set(pairs)}
        return pd.Series([known[p] for p in pairs], dtype="float64")

    return scored


def add_rewards(paths: DataFrame, rewards: dict[str, Reward], step_offset: str = "natural") -> DataFrame:
    """A column for each reward of (step, state). ``step_offset``: ``natural`` scores a row with its own step,
    ``reference`` with the step before, so steps 0 and 1 both count as 0."""
    step = F.col("step") if step_offset == "natural" else F.greatest(F.col("step") - 1, F.lit(0))
    return paths.withColumns({name: f(step, F.col("state")) for name, f in rewards.items()})


def reward_totals(paths: DataFrame, keys: list[str], reward: str) -> DataFrame:
    """Total of a reward by run, per step, and per year of 52 steps."""
    total = F.coalesce(F.sum(reward), F.lit(0.0))
    return paths.groupBy(*keys, "run_id").agg(
        total.alias("total"), F.count("*").alias("n_steps"), (total / F.count("*")).alias("per_step"),
        (total / (F.count("*") / 52)).alias("per_year"),
    )


def event_rates(paths: DataFrame, keys: list[str], years: Column) -> DataFrame:
    """Mean yearly number of steps in any bleeding state and in the joint state; step 0 doesn't count, and runs without
    a bleed do. ``years`` is an aggregate over a run."""
    after = F.col("step") >= 1
    runs = paths.groupBy(*keys, "run_id").agg(
        F.sum((after & F.col("state").isin(*BLEEDING)).cast("long")).alias("_all"),
        F.sum((after & (F.col("state") == MAJOR)).cast("long")).alias("_joint"),
        years.alias("_years"),
    )
    return runs.groupBy(*keys).agg(
        F.avg(F.col("_all") / F.col("_years")).alias("abr"), F.avg(F.col("_joint") / F.col("_years")).alias("ajbr"),
        F.count("*").alias("n_runs"),
    )


def mean_totals(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over runs of their total dose and cost."""
    runs = paths.groupBy(*keys, "run_id").agg(
        F.coalesce(F.sum("dose"), F.lit(0.0)).alias("d"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")
    )
    return runs.groupBy(*keys).agg(F.avg("d").alias("mean_dose"), F.avg("c").alias("mean_cost"))


def state_shares(paths: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """Share of a scenario's runs in each of the states at each step, dense over steps and states."""
    runs = paths.groupBy(*keys).agg(F.count_distinct("run_id").alias("_runs"), F.max("step").alias("_last"))
    grid = runs.select(*keys, "_runs", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("step")).select(
        "*", F.explode(F.array(*[F.lit(s) for s in states])).alias("state")
    )
    counts = paths.filter(F.col("state").isin(*states)).groupBy(*keys, "step", "state").agg(F.count("*").alias("_n"))
    joined = grid.join(counts, [*keys, "step", "state"], "left")
    return joined.select(*keys, "step", "state", (F.coalesce("_n", F.lit(0)) / F.col("_runs")).alias("share"))


def moving_average(shares: DataFrame, keys: list[str], value: str, width: int = 13) -> DataFrame:
    """Mean of the last ``width`` steps, for full windows only, labelled by the last step."""
    frame = Window.partitionBy(*keys, "state").orderBy("step").rowsBetween(1 - width, 0)
    df = shares.withColumn("moving", F.avg(value).over(frame)).withColumn("_n", F.count("*").over(frame))
    return df.filter(F.col("_n") == width).drop("_n", value)


def streaks(paths: DataFrame, keys: list[str], state: str = INHIBITOR) -> DataFrame:
    """Adds how many steps in a row the run has been in the state, 0 outside it."""
    line = run_line(keys)
    left = F.sum(F.when(F.col("state") == state, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    df = paths.withColumn("_stay", left)
    inside = Window.partitionBy(*keys, "run_id", "_stay").orderBy("step")
    at = F.sum(F.when(F.col("state") == state, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("streak", F.when(F.col("state") == state, at).otherwise(0).cast("long")).drop("_stay")


def successors(
    paths: DataFrame, keys: list[str], stages: DataFrame, after: str = INHIBITOR, among: tuple[str, ...] = (NO_BLEED, CHRONIC, SEVERE)
) -> DataFrame:
    """Percent of each tallied next state after visits to ``after``, and the visits that have a next step.

    Only states of the scenario's stage are listed; if none was tallied, all get 0. ``stages`` has the keys and state.
    """
    nexts = paths.withColumn("_next", F.lead("state").over(run_line(keys))).filter(
        (F.col("state") == after) & F.col("_next").isNotNull()
    )
    visits = nexts.groupBy(*keys).agg(F.count("*").alias("n_visits"))
    tallied = nexts.groupBy(*keys, F.col("_next").alias("state")).agg(F.count("*").alias("_n"))
    grid = paths.select(*keys).distinct().join(stages.filter(F.col("state").isin(*among)), keys)
    df = grid.join(tallied, [*keys, "state"], "left").join(visits, keys, "left")
    n = F.coalesce("_n", F.lit(0))
    total = F.sum(n).over(Window.partitionBy(*keys))
    return df.select(
        *keys, "state", F.when(total > 0, 100 * n / total).otherwise(0.0).alias("percent"),
        F.coalesce("n_visits", F.lit(0)).alias("n_visits"),
    )


def first_steps(paths: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The first steps of each scenario's first run."""
    first = paths.groupBy(*keys).agg(F.min("run_id").alias("run_id"))
    rows = paths.join(first, [*keys, "run_id"])
    return rows.withColumn("_k", F.row_number().over(run_line(keys))).filter(F.col("_k") <= n).drop("_k")


def side_by_side(df: DataFrame, keys: list[str], value: str, regimes: tuple[str, ...] = ("on_demand", "prophylaxis")) -> DataFrame:
    return df.groupBy(*keys).pivot("regime", list(regimes)).agg(F.first(value))


def long_paths(runs: DataFrame) -> DataFrame:
    """Rows (scenario, run_id, state_path, weekly_doses, weekly_costs) of equally long arrays as one row per step."""
    zipped = F.arrays_zip(
        F.col("state_path").alias("state"), F.col("weekly_doses").alias("dose"), F.col("weekly_costs").alias("cost")
    )
    return runs.select("scenario", "run_id", F.posexplode(zipped).alias("step", "z")).select(
        "scenario", "run_id", "step", F.col("z.state").alias("state"), F.col("z.dose").alias("dose"), F.col("z.cost").alias("cost")
    )
