"""Filters, sales, joins and sources on small inline tables."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators import filters, flows, pyramid, sales
from cohortry.sources import html_fields, sinks, tables


def rows(df, *names):
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=str)


def test_text_filter_nulls(spark):
    df = spark.createDataFrame(
        [("Factor VIII", "Recombinant x"), ("factor viii + VON Willebrand", "x"), (None, "x"), ("FACTOR viii", None)],
        "active_ingredient string, generic_name string",
    )
    assert filters.factor_viii(df).count() == 2
    assert rows(filters.factor_viii(df, True)) == [("Factor VIII", "Recombinant x")]
    assert rows(filters.factor_viii(df, False)) == [("FACTOR viii", None)]


def test_other_factors(spark):
    df = spark.createDataFrame([("Factor VIII",), ("factor VIIa",), ("Factor mix",), (None,), ("factor XIII",)], "generic_name string")
    assert rows(filters.other_factors(df)) == [("Factor VIII",)]


def test_total_sales_edges(spark):
    df = spark.createDataFrame(
        [("a", 2, 5.0), ("a", None, None), (None, 9, 9.0), ("zero", 0, 7.0), ("none", None, None), ("half", 2, 5.0)],
        "generic_name string, sale_count long, sale_amount double",
    )
    got = {r.generic_name: (r.sale_count, r.sale_amount, r.price_per_package) for r in sales.total_sales(df).collect()}
    assert got == {"a": (2, 5.0, 2.0), "zero": (0, 7.0, None), "none": (0, 0.0, None), "half": (2, 5.0, 2.0)}


def test_merge_common_columns(spark):
    left = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "k string, v int").withColumn("x", F.lit(1))
    right = spark.createDataFrame([(None, "a"), (2, "c")], "v int, k string").withColumn("y", F.lit(1))
    merged = sales.merge_common_columns(left, right)
    assert merged.columns == ["k", "v"]
    assert rows(merged) == rows(sales.merge_common_columns(right, left).select("k", "v"))
    assert rows(merged) == [("a", None), ("a", None), ("b", 1), ("c", 2)]


def test_brand_totals_and_first(spark):
    df = spark.createDataFrame(
        [("b", None, 1, 1), ("b", "late", 2, 3), ("b", "later", None, 4), (None, "n", 5, 5)], "brand string, name string, n int, ord int"
    )
    assert rows(sales.brand_totals(df, "brand", ["name"], ["n"], ["ord"])) == [("b", "late", 3)]
    assert rows(sales.first_rows(df, "brand", ["ord"]), "brand", "ord") == [("b", 1), (None, 5)]


def test_part_profile_counts_null_once(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, 3), (1, "a", None)], "part int, name string, code int")
    assert rows(sales.part_profile(df, "part", "code", ["name", "code"])) == [(1, 1, 2, 2, 3)]


def test_unit_consumption_modes(spark):
    df = spark.createDataFrame(
        [(1, "x 10 [iU]", 2), (1, "x 10 [iU]", 3), (1, "no dose", 5), (2, "y 4 [iU]", 1)], "part int, name string, units long"
    )
    assert rows(sales.unit_consumption(df, "part", "name", "units")) == [(1, "x 10 [iU]", 50), (2, "y 4 [iU]", 4)]
    assert rows(sales.unit_consumption(df, "part", "name", "units", True)) == [(1, "x 10 [iU]", 100), (2, "y 4 [iU]", 4)]


def test_clean_ages(spark):
    df = spark.createDataFrame([("0", "5", "6"), ("100+", "1", None), ("all", "9", "9"), ("7", None, "1")], "Age string, M string, F string")
    assert rows(pyramid.clean_ages(df)) == [(0, 5), (100, 1)]
    assert rows(pyramid.clean_ages(df, drop_female=False)) == [(0, 5, 6)]


def test_patient_ages(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'Country,Total number of patients,0-4,5-13,14-18,19-44,45+,Age not known\n"A\nB","2,124",4%,14%,15%,57%,10%,0%\n'
        "C,5,0%,0%,0%,0%,0%,100%\nD,7,1%,1%,1%,1%,96%,0%\n"
    )
    df = tables.read_patient_ages(spark, {"a": str(path)})
    assert rows(df, "Country", "patients") == [("A\nB", 2124), ("D", 7)]
    shares = tables.age_shares(df)
    assert shares.count() == 10
    assert {round(r.share, 2) for r in shares.filter("Country = 'D'").collect()} == {0.01, 0.96}


def test_pyramids_take_year_from_name(spark, tmp_path):
    for year in (2014, 2016):
        (tmp_path / f"X_{year}.csv").write_text("Age,M,F\n0,10,11\n100+,1,2\n")
    df = tables.read_pyramids(spark, [str(tmp_path / f"X_{y}.csv") for y in (2014, 2016)])
    assert rows(df, "year", "Age", "M") == [(2014, 0, 10), (2014, 100, 1), (2016, 0, 10), (2016, 100, 1)]
    totals = pyramid.yearly_totals(pyramid.with_prevalence(df, "M", "s", 0.5), "s")
    assert rows(totals, "year", "max_age", "max_m", "total") == [(2014, 100, 10, 5.5), (2016, 100, 10, 5.5), (None, 100, 10, 11.0)]


def test_missing_file(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, "/nowhere/at/all.parquet", {})


def test_renames_keep_blanks(spark, tmp_path):
    path = tmp_path / "s1.csv"
    path.write_text("نام ژنریک,فروش عددی ,OTC,other\nx,3,y,z\n")
    df = tables.read_table(spark, str(path), tables.SALES_1399)
    assert df.columns == ["generic_name", "sale_count", "otc", "other"]
    assert df.first().sale_count == 3
    assert tables.read_shipments(spark, [str(path)]).first().part == 1


def test_price_list(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("﻿persian_name,english_name,price\na,Factor VIII x,\"300,000-\"\nb,Factor VIII y,N/A\nc,factor viii z,100\nd,von Willebrand factor viii,900000\n")
    assert rows(tables.factor_prices(tables.read_prices(spark, str(path)))) == [("a", "Factor VIII x", 300000.0)]


def test_guarded_write(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.save(spark.range(2), out)
    sinks.save(spark.range(5), out, override=False)
    assert spark.read.parquet(out).count() == 2
    sinks.save(spark.range(5), out)
    assert spark.read.parquet(out).count() == 5


def test_save_sales(spark, tmp_path):
    df = spark.createDataFrame(
        [("Factor VIII", "human", 2, 3, 5.0, "x"), ("Factor VIII", "Recombinant", 1, 2, 9.0, "x"), ("other", "human", 1, 1, 1.0, "x")],
        "active_ingredient string, generic_name string, count_of_package_sold long, sale_count long, sale_amount double, otc string",
    )
    sinks.save_sales(df, df, str(tmp_path / "o"))
    assert {p.name for p in (tmp_path / "o").iterdir()} == {"dataset", "1400", "1399", "recombinant_1400"}
    dataset = spark.read.parquet(str(tmp_path / "o" / "dataset"))
    assert dataset.columns == ["generic_name", "sale_count", "sale_amount", "price_per_package"]
    assert rows(dataset) == [("Recombinant", 2, 9.0, 4.0), ("human", 3, 5.0, 2.0)]
    assert rows(spark.read.parquet(str(tmp_path / "o" / "1399")), "generic_name", "count_of_package_sold") == [("Recombinant", 1), ("human", 2)]
    sinks.save_records(df, ["generic_name"], str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["generic_name"]


def test_no_recombinant_rows(spark):
    df = spark.createDataFrame(
        [("Factor VIII", None, 2, 3, 5.0)], "active_ingredient string, generic_name string, count_of_package_sold long, sale_count long, sale_amount double"
    )
    found = flows.sales_tables(df, df)
    assert found["recombinant_1400"].isEmpty() and found["dataset"].isEmpty()


LISTING = """<div class="searchRow"><span class="titleSearch-Link-RtlAlter"><a>پ</a></span><span class="titleSearch-Link-ltrAlter"><a> Factor </a></span>
<div class="row"><div><label>صاحب برند</label><span>one</span></div><div><label>صاحب برند</label><bdo>two</bdo></div>
<div><label>کد ژنریک</label><span>77</span></div><div><label>no rule</label><span>x</span></div><div><span>no label</span></div></div></div>
<div class="searchRow"><span class="titleSearch-Link-ltrAlter"><a>Only one</a></span><div class="row"><div><label>قیمت هر بسته</label><span>5</span></div></div></div>"""


def test_listing_records(spark):
    pages = spark.createDataFrame([(1, LISTING), (2, None), (3, "<p>")], "page_id long, html string")
    got = {r.block_no: r for r in html_fields.records(html_fields.label_values(pages)).collect()}
    assert (got[0].persian_name, got[0].english_name, got[0].brand, got[0].generic_code, got[0].price) == ("پ", "Factor", "two", "77", "N/A")
    assert (got[1].persian_name, got[1].english_name, got[1].price) == ("N/A", "N/A", "5")
    assert len(got) == 2
