"""Event rates turned into weekly probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKS = 52


def weekly_rate(rate: Column, period: Column | str, on_unknown: str = "error", floor: bool = True) -> Column:
    """Events a week from events in ``period``, ``annual`` or ``weekly``.

    ``on_unknown``: what another period gives, ``error``, ``zero`` (a rate of 0) or ``weekly``. ``floor``: a negative
    rate counts as 0. A null rate gives null.
    """
    period = F.lit(period) if isinstance(period, str) else period
    rate = F.when(rate < 0, F.lit(0.0)).otherwise(rate) if floor else rate
    other = {
        "error": F.raise_error(F.concat(F.lit("Unsupported period: "), F.coalesce(period, F.lit("null")))).cast("double"),
        "zero": F.lit(0.0),
        "weekly": rate,
    }[on_unknown]
    return F.when(period == "annual", rate / WEEKS).when(period == "weekly", rate).otherwise(other)


def at_least_one(rate: Column, period: Column | str = "annual", on_unknown: str = "error") -> Column:
    """Probability of one event or more in a week."""
    return -F.expm1(-weekly_rate(rate, period, on_unknown))


def no_event(rate: Column, period: Column | str = "annual", on_unknown: str = "error") -> Column:
    """Probability of no event in a week; an unknown period under ``zero`` gives 1."""
    return F.exp(-weekly_rate(rate, period, on_unknown))


def bleed_probabilities(df: DataFrame, all_rate: str, joint_rate: str, severe_prob: str) -> DataFrame:
    """Adds minor, major, life_threatening, weekly_severe and healthy to a table of yearly rates.

    Minor events are all less joint ones; ``severe_prob`` is a yearly probability, spread evenly over weeks and then
    taken as a weekly rate; healthy is what remains.
    """
    weekly_severe = F.col(severe_prob) / WEEKS
    df = df.withColumns(
        {
            "minor": at_least_one(F.col(all_rate) - F.col(joint_rate)),
            "major": at_least_one(F.col(joint_rate)),
            "life_threatening": at_least_one(weekly_severe, "weekly"),
            "weekly_severe": weekly_severe,
        }
    )
    return df.withColumn("healthy", 1 - (F.col("minor") + F.col("major") + F.col("life_threatening")))
