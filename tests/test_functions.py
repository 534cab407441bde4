"""Scalar functions against fixed values computed from the formulas, and edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from cohortry.functions import blend, body, rates, text


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "week, kilos", [(0, 3.7), (52, 5.42), (520, 35.53), (936, 60.65), (2600, 80.17), (2601, 80.0), (3796, 75.0)]
)
def test_growth_weight(spark, week, kilos):
    assert one(spark, body.growth_weight, week, "int") == pytest.approx(kilos, abs=0.011)


@pytest.mark.parametrize("week", [-1, 3797])
def test_growth_weight_out_of_range(spark, week):
    with pytest.raises(Exception, match="between 0 and 3796"):
        one(spark, body.growth_weight, week, "int")


@pytest.mark.parametrize(
    "week, kilos",
    [(-9, 3.5), (0, 3.5), (52, 6.0), (104, 11.17), (105, 12.05), (624, 40.0), (936, 70.0), (937, 74.87), (3380, 71.08),
     (3381, 69.99), (3796, 65.0), (9999, 65.0)],
)
def test_staged_weight(spark, week, kilos):
    assert one(spark, body.staged_weight, week, "int") == pytest.approx(kilos, abs=0.011)


def test_null_weights(spark):
    assert one(spark, body.growth_weight, None, "int") is None
    assert one(spark, body.staged_weight, None, "int") is None


@pytest.mark.parametrize("rate, p", [(8.0, 0.142596), (34.0, 0.479958), (2.0, 0.037731), (3.66, 0.0679647), (48.24, 0.6045347), (-3.0, 0.0)])
def test_at_least_one(spark, rate, p):
    assert one(spark, rates.at_least_one, rate, "double") == pytest.approx(p, abs=1e-6)
    assert one(spark, rates.no_event, rate, "double") == pytest.approx(1 - p, abs=1e-6)


def test_periods(spark):
    df = spark.createDataFrame([("annual",), ("weekly",), ("daily",)], "p string")
    rate = F.lit(2.0)
    got = [r[0] for r in df.select(rates.at_least_one(rate, F.col("p"), "zero")).collect()]
    assert got == pytest.approx([1 - math.exp(-2 / 52), 1 - math.exp(-2), 0.0])
    assert [r[0] for r in df.select(rates.no_event(rate, F.col("p"), "zero")).collect()][2] == 1.0
    with pytest.raises(Exception, match="Unsupported period"):
        df.select(rates.at_least_one(rate, F.col("p"))).collect()


def test_bleed_probabilities(spark):
    df = spark.createDataFrame([(44.0, 34.0, 0.52)], "abr double, ajbr double, ltb double")
    r = rates.bleed_probabilities(df, "abr", "ajbr", "ltb").first()
    assert r.weekly_severe == pytest.approx(0.01)
    assert r.minor + r.major + r.life_threatening + r.healthy == pytest.approx(1)


@pytest.mark.parametrize("age, s", [(0, 1.0), (50, 0.5), (120, 0.0), (-5, 1.0)])
def test_linear_survival(spark, age, s):
    assert one(spark, body.linear_survival, age, "int") == s


@pytest.mark.parametrize("raw, value", [("4%", 0.04), (" 12 % ", 0.12), ("۴%", 0.04), ("n/a", None), (None, None), ("", None)])
def test_share(spark, raw, value):
    assert one(spark, text.share, raw, "string") == (pytest.approx(value) if value is not None else None)


@pytest.mark.parametrize("raw, value", [("2,124", 2124), ("7", 7), ("x", None), (None, None)])
def test_thousands(spark, raw, value):
    assert one(spark, text.thousands, raw, "string") == value


def test_price(spark):
    assert one(spark, text.price, "12,500-", "string") == 12500.0
    assert one(spark, text.price, "", "string") is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, text.price, "ten", "string")


@pytest.mark.parametrize(
    "f, raw, value",
    [(text.unit_dose, "factor 500 [iU]", 500), (text.unit_dose, "factor 500 [IU]", None), (text.first_integer, "a 25 b 3", 25),
     (text.first_integer, "none", None), (text.brand_prefix, "KOATE DVI  500", "KOATE DVI"), (text.brand_prefix, "Koate  500", None),
     (text.brand_prefix, None, None)],
)
def test_names(spark, f, raw, value):
    assert one(spark, f, raw, "string") == value


def test_strict_dosage(spark):
    with pytest.raises(Exception, match="no number"):
        one(spark, lambda c: text.first_integer(c, strict=True), "none", "string")


@pytest.mark.parametrize("v, k", [(0, 0), (4.9, 0), (5, 1), (73.9, 4), (74, None), (-1, None), (None, None)])
def test_half_open_bin(spark, v, k):
    assert one(spark, lambda c: blend.half_open_bin(c, [0, 5, 14, 19, 45, 74]), None if v is None else float(v), "double") == k
