"""Population by age and sex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVALENCE = 1.1 / 100_000


def clean_ages(df: DataFrame, drop_female: bool = True) -> DataFrame:
    """``100+`` becomes 100; Age, M (and F) become integers; rows that lack one of them are dropped."""
    age = F.when(F.col("Age") == "100+", F.lit("100")).otherwise(F.col("Age").cast("string"))
    kept = ["Age", "M"] if drop_female else ["Age", "M", "F"]
    df = df.withColumns({c: (age if c == "Age" else F.col(c).cast("string")).try_cast("double").cast("int") for c in kept})
    df = df.na.drop(subset=kept)
    return df.drop("F") if drop_female else df


def with_prevalence(df: DataFrame, population: str, out: str, prevalence: float = PREVALENCE) -> DataFrame:
    return df.withColumn(out, F.col(population) * F.lit(prevalence))


def yearly_totals(df: DataFrame, scaled: str) -> DataFrame:
    """By year, and for all years (null year): oldest age, largest M, sum of the scaled column."""
    return df.rollup("year").agg(F.max("Age").alias("max_age"), F.max("M").alias("max_m"), F.sum(scaled).alias("total"))
