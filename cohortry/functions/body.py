"""Body weight by age in weeks, and a linear survival curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_WEEK = 73 * 52


def growth_weight(week: Column) -> Column:
    """Gompertz growth to week 2600, then a straight fall from 80 kg to 75 kg at the last week; two decimals. Other
    weeks raise an error."""
    grown = 80.5 * F.exp(-3.08 * F.exp(-0.00255 * week))
    falling = 80.0 - 5.0 * (week - 2600) / (LAST_WEEK - 2600)
    weight = F.bround(F.when(week <= 2600, grown).otherwise(falling), 2)
    return F.when(week.between(0, LAST_WEEK), weight).when(
        week.isNotNull(), F.raise_error(F.lit("week must lie between 0 and 3796")).cast("double")
    )


def staged_weight(week: Column) -> Column:
    """Five pieces: logistic to 104 with a floor of 3.5 kg, straight lines to 624 and 936, a wave to 3380, a straight
    fall; two decimals. Weeks outside 0..3796 count as the nearest end."""
    w = F.greatest(F.lit(0), F.least(week, F.lit(LAST_WEEK)))
    w = F.when(week.isNotNull(), w)
    infant = F.greatest(F.lit(3.5), 12 / (1 + F.exp(-0.05 * (w - 52))))
    kilos = (
        F.when(w <= 104, infant)
        .when(w <= 624, 12 + (w - 104) * (28 / 520))
        .when(w <= 936, 40 + (w - 624) * (30 / 312))
        .when(w <= 3380, 70 + 5 * F.sin(w / 520))
        .otherwise(70 - (w - 3380) * 5 / 416)
    )
    return F.bround(kilos, 2)


def linear_survival(age: Column, most: float = 100) -> Column:
    """Share alive at an age: falls from 1 to 0 at ``most``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(most)) - age) / most))
