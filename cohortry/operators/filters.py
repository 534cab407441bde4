"""Row filters on names and prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.text import contains_any_case, price

Rule = tuple[str, str]


def text_filter(df: DataFrame, include: Sequence[Rule] = (), exclude: Sequence[Rule] = ()) -> DataFrame:
    """Rows whose columns contain every included text and no excluded one, in any case.

    A null column contains nothing, so it fails an inclusion and passes an exclusion.
    """
    return df.filter(_condition(include, exclude))


def _condition(include: Sequence[Rule], exclude: Sequence[Rule]) -> Column:
    keep = F.lit(True)
    for column, part in include:
        keep = keep & contains_any_case(F.col(column), part)
    for column, part in exclude:
        keep = keep & ~contains_any_case(F.col(column), part)
    return keep


def factor_viii_condition() -> Column:
    """True for the rows that ``factor_viii`` keeps."""
    return _condition([("active_ingredient", "factor viii")], [("active_ingredient", "von willebrand")])


def factor_viii(df: DataFrame, recombinant: bool | None = None) -> DataFrame:
    """Rows of the ingredient without its carrier; ``recombinant``: only those (True), none of those (False)."""
    ingredient, generic = "active_ingredient", "generic_name"
    include, exclude = [(ingredient, "factor viii")], [(ingredient, "von willebrand")]
    if recombinant is not None:
        (include if recombinant else exclude).append((generic, "recombinant"))
    return text_filter(df, include, exclude)


def other_factors(df: DataFrame, column: str = "generic_name") -> DataFrame:
    """Names with ``factor`` but none of ``viia``, ``ix``, ``xiii`` as plain parts (so ``mix`` is out as well); null
    names are dropped."""
    named = df.filter(F.col(column).isNotNull())
    return text_filter(named, [(column, "factor")], [(column, p) for p in ("viia", "ix", "xiii")])


def priced(df: DataFrame, column: str = "price", above: float = 200_000) -> DataFrame:
    """Strictly parsed prices above a threshold; rows without a price are dropped."""
    return df.withColumn(column, price(F.col(column))).filter(F.col(column).isNotNull() & (F.col(column) > above))


def fully_known(df: DataFrame, column: str = "Age not known") -> DataFrame:
    """Rows whose unknown share is exactly 0."""
    return df.filter(F.col(column) == 0.0)


def in_states(df: DataFrame, states: DataFrame, column: str = "state") -> DataFrame:
    """Rows whose state is among those of a small dimension table."""
    return df.join(states.select(F.col("state").alias(column)).distinct(), column, "left_semi")
