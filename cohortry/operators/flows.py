"""The yearly sales flow: from two years' raw rows to four result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.text import brand_prefix, first_integer
from cohortry.operators.filters import factor_viii, other_factors, text_filter
from cohortry.operators.sales import brand_totals, first_rows, merge_common_columns, total_sales, unit_price

UNUSED = ("supplier", "otc", "biologic", "brand_name")


def recombinant_rows(sales: DataFrame) -> DataFrame:
    """Recombinant factor rows with their unit price; none if there is none."""
    return factor_viii(sales, True).withColumn("price_per_package", unit_price(F.col("sale_amount"), F.col("sale_count")))


def sales_tables(sales_1400: DataFrame, sales_1399: DataFrame) -> dict[str, DataFrame]:
    """``1400``: totals of the rows that aren't recombinant; ``recombinant_1400``: those that are; ``1399``: totals of
    all factor rows by packages; ``dataset``: the first two on their common columns."""
    first, second = sales_1400.drop(*UNUSED), sales_1399.drop(*UNUSED)
    recombinant = recombinant_rows(first)
    human = total_sales(factor_viii(first, False))
    all_1399 = total_sales(factor_viii(second), count="count_of_package_sold")
    return {
        "dataset": merge_common_columns(human, recombinant), "1400": human, "1399": all_1399, "recombinant_1400": recombinant,
    }


def tables_2023(sales: DataFrame, order: list[str], strict: bool = False) -> dict[str, DataFrame]:
    """``dataset``: factor names, one row of each brand; ``prices``: factor VIII rows summed by brand, with the brand's
    leading capitals and the dosage of its first name. ``order`` says which row of a brand is the first; ``strict``: a
    name without a number raises an error."""
    kept = ["index_latin_name", "brand_latin_name", "generic_name", "generic_code", "irc_code"]
    names = first_rows(other_factors(sales), "brand_latin_name", order).select(*kept)
    rows = text_filter(sales, [("generic_name", "factor viii")])
    totals = brand_totals(rows, "brand_latin_name", ["generic_name"], ["count_of_package_sold", "sale_count", "sale_amount"], order)
    prices = totals.withColumn("dosage", first_integer(F.col("generic_name"), strict))
    return {"dataset": names, "prices": prices.withColumn("brand_latin_name", brand_prefix(F.col("brand_latin_name")))}
