"""Fixed dimensions: stages with their states, treatment regimes, transition rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.rates import WEEKS, at_least_one

#: States of each stage, in order.
STAGES = {
    "early": [
        "alive_wo_arthropathy", "minor_bleeding", "articular_bleeding", "life_treating_bleeding", "surgery",
        "inhibitor", "death", "chronic_arthropathy",
    ],
    "intermediate": [
        "chronic_arthropathy", "minor_bleeding", "articular_bleeding", "life_treating_bleeding", "surgery",
        "inhibitor", "death", "severe_arthropathy",
    ],
    "end": [
        "severe_arthropathy", "minor_bleeding", "articular_bleeding", "life_treating_bleeding", "surgery",
        "inhibitor", "joint_replacement", "death",
    ],
}
NO_BLEED, CHRONIC, SEVERE = "alive_wo_arthropathy", "chronic_arthropathy", "severe_arthropathy"
MINOR, MAJOR, LIFE_THREATENING = "minor_bleeding", "articular_bleeding", "life_treating_bleeding"
SURGERY, REPLACEMENT, INHIBITOR, DEATH = "surgery", "joint_replacement", "inhibitor", "death"
BLEEDING = (MINOR, MAJOR, LIFE_THREATENING)

#: Doses (IU/kg) and durations (days) by site, and the weight of each site in its kind of bleed.
DOSES = {"joint": 25.0, "muscle": 31.5, "mucous": 25.0, "intracranial": 32.0, "neck_throat": 35.0, "gastro": 45.0}
DAYS = {"joint": 2, "muscle": 5, "mucous": 3, "intracranial": 21, "neck_throat": 14, "gastro": 11}
SITES = {
    "major": {"joint": 1.0},
    "minor": {"muscle": 0.05, "mucous": 0.1},
    "lt": {"intracranial": 0.015, "neck_throat": 0.01, "gastro": 0.02},
}
#: Events a year, prices, weekly probabilities.
RATES = {"on_demand": {"abr": 44.0, "ajbr": 34.0}, "prophylaxis": {"abr": 3.76, "ajbr": 3.66}}
LIFE_THREATENING_PART, EXTRA_ARTICULAR_PART = 0.045, 0.15
AVERAGE_DOSE, UNIT_PRICE = 25.805, 58_000.0
RESOLVED, CRITICAL_RESOLVED, CRITICAL_DEATH, THERAPY_RESOLVED = 0.95, 0.95, 2.4e-5, 0.0085
INHIBITOR_RISK = {"on_demand": 0.00414, "prophylaxis": 0.00215}
PROGRESSION_RISK = {"on_demand": 0.000435, "prophylaxis": 0.0000939}


def stage_states(spark: SparkSession) -> DataFrame:
    rows = [(stage, k, state) for stage, states in STAGES.items() for k, state in enumerate(states)]
    return spark.createDataFrame(rows, "stage string, ord int, state string")


def treatments(spark: SparkSession) -> DataFrame:
    """One row per regime: doses, durations in weeks, yearly rates, price, and for each kind of bleed the weighted dose
    per kg and number of injections. On-demand derived rates are rounded, the extra-articular one plus one."""
    rows = []
    for regime, rate in RATES.items():
        severe, outside = rate["abr"] * LIFE_THREATENING_PART, rate["abr"] * EXTRA_ARTICULAR_PART
        if regime == "on_demand":
            severe, outside = float(round(severe)), float(round(outside) + 1)
        rows.append(
            (regime, *DOSES.values(), *[d / 7 for d in DAYS.values()], AVERAGE_DOSE, rate["abr"], rate["ajbr"], severe,
             outside, UNIT_PRICE, INHIBITOR_RISK[regime], PROGRESSION_RISK[regime])
        )
    names = [
        "regime string", *[f"dose_{s} double" for s in DOSES], *[f"duration_{s} double" for s in DAYS],
        "avg_dose_per_bleed double", "abr double", "ajbr double", "albr double", "eabr double",
        "price_per_unit double", "inhibitor_risk double", "progression_risk double",
    ]
    df = spark.createDataFrame(rows, ", ".join(names))
    for kind, sites in SITES.items():
        whole = sum(sites.values())
        dose = sum((F.col(f"dose_{s}") * w for s, w in sites.items()), F.lit(0.0)) / whole
        weeks = sum((F.col(f"duration_{s}") * w for s, w in sites.items()), F.lit(0.0)) / whole
        df = df.withColumns({f"{kind}_per_kg": dose, f"{kind}_injections": F.ceil(weeks)})
    return df


def transition_rules(spark: SparkSession, rates: DataFrame | None = None) -> DataFrame:
    """(scenario, regime, stage, from_state, to_state, prob): weekly rules of each regime and all stages, cut to the
    stage's states, before any row is repaired. ``rates`` has regime, abr, ajbr, albr, eabr, inhibitor_risk and
    progression_risk; by default those of ``treatments``.

    Where the weekly event probabilities of the no-bleed row sum to more than what no bleed leaves, they are scaled.
    """
    t = treatments(spark) if rates is None else rates
    stages = stage_states(spark)
    has = stages.groupBy("stage").agg(
        *[F.max((F.col("state") == s).cast("int")).alias(n) for n, s in (("chronic_in", CHRONIC), ("inhibitor_in", INHIBITOR))]
    )
    weekly = t.crossJoin(F.broadcast(has)).select(  # three stages
        "regime", "stage", at_least_one(F.lit(float(WEEKS)) - F.col("abr")).alias("stay"),
        at_least_one(F.col("eabr")).alias("minor"), at_least_one(F.col("ajbr")).alias("major"),
        at_least_one(F.col("albr")).alias("lt"), F.col("progression_risk").alias("progress"),
        F.col("inhibitor_risk").alias("inhibit"), "chronic_in", "inhibitor_in",
    )
    others = (
        F.col("minor") + F.col("major") + F.col("lt") + F.col("progress") * F.col("chronic_in")
        + F.col("inhibit") * F.col("inhibitor_in")
    )
    scale = F.when(others > 1 - F.col("stay"), (1 - F.col("stay")) / others).otherwise(F.lit(1.0))
    # with the fixed rates the no-bleed row's sum stays below 1, so their scale is 1
    weekly = weekly.withColumn("scale", scale).withColumns(
        {c: F.col(c) * F.col("scale") for c in ("minor", "major", "lt", "progress", "inhibit")}
    )
    bleeds = [(MINOR, "minor"), (MAJOR, "major"), (LIFE_THREATENING, "lt")]
    from_bleed = [(NO_BLEED, "stay"), *bleeds, (CHRONIC, "progress"), (INHIBITOR, "inhibit")]
    rules = {
        **dict.fromkeys((NO_BLEED, MINOR, MAJOR), from_bleed),
        LIFE_THREATENING: [(NO_BLEED, CRITICAL_RESOLVED), (DEATH, CRITICAL_DEATH), (INHIBITOR, "inhibit")],
        CHRONIC: [(SEVERE, "progress"), *bleeds, (INHIBITOR, "inhibit")],
        SEVERE: [*bleeds, (INHIBITOR, "inhibit")],
        SURGERY: [(NO_BLEED, RESOLVED), (INHIBITOR, "inhibit")],
        REPLACEMENT: [(SEVERE, RESOLVED), (INHIBITOR, "inhibit")],
        INHIBITOR: [(INHIBITOR, 1 - THERAPY_RESOLVED), (MINOR, THERAPY_RESOLVED)],
        DEATH: [(DEATH, 1.0)],
    }
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("from_state"), F.lit(b).alias("to_state"),
                (F.col(p) if isinstance(p, str) else F.lit(float(p))).alias("prob"),
            )
            for a, row in rules.items()
            for b, p in row
        ]
    )
    long = weekly.select("regime", "stage", F.explode(cells).alias("c")).select("regime", "stage", "c.*")
    for side in ("from_state", "to_state"):
        long = long.join(F.broadcast(stages.select("stage", F.col("state").alias(side))), ["stage", side], "left_semi")
    return long.select(
        F.concat_ws("/", "regime", "stage").alias("scenario"), "regime", "stage", "from_state", "to_state", "prob"
    )
