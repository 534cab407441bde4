"""Checked readers, column profiles, one-pass results, deep listings, merged hot keys and stored scenarios."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortry.operators import matrix, profiles, sales
from cohortry.sources import dimensions as dim
from cohortry.sources import html_fields, scenarios, sinks, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


HEADER = "نام ژنریک,فروش عددی ,فروش ریالی مصرف کننده ,OTC,other\n"


def test_records_that_do_not_fit_are_kept_beside_the_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + 'x,3,1.5,y,z\n"a, ""b"" ",4,,,\ntoo,1,2\nmany,1,2,3,4,5,6\nword,three,1.5,y,z\nhalf,1.5,1,y,z\nempty,,,y,z\nmoney,2,free,y,z\n'
    )
    rows, rejected = tables.read_checked(spark, str(tmp_path / "a.csv"), tables.SALES_1399, ("generic_name", "sale_count"))
    assert [(f.name, f.dataType.typeName()) for f in rows.schema][:3] == [("generic_name", "string"), ("sale_count", "long"), ("sale_amount", "double")]
    assert {(r.generic_name, r.sale_count, r.sale_amount) for r in rows.collect()} == {("x", 3, 1.5), ('a, "b" ', 4, None), ("empty", None, None)}
    bad = {r.first_cell: r.record for r in rejected.collect()}
    assert set(bad) == {"too", "many", "word", "half", "money"}
    assert bad["word"] == "word,three,1.5,y,z" and bad["too"] == "too,1,2"
    # whichever columns a query uses, the same records are rejected
    assert rows.select("generic_name").count() == rows.select("other").distinct().count() + 1 == 3
    assert rejected.select("file").distinct().count() == 1


def test_a_header_without_a_needed_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="generic_name, sale_count"):
        tables.read_checked(spark, str(tmp_path / "a.csv"), tables.SALES_1399, ("sale_count", "generic_name"))


def test_quoted_line_ends_need_multiline(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '"a\nb",3,1.5,y,z\nc,4,1,y,z\n')
    rows, rejected = tables.read_checked(spark, str(tmp_path / "a.csv"), tables.SALES_1399, multiline=True)
    assert sorted(r.generic_name for r in rows.collect()) == ["a\nb", "c"] and rejected.isEmpty()
    rows, rejected = tables.read_checked(spark, str(tmp_path / "a.csv"), tables.SALES_1399)
    assert sorted(r.generic_name for r in rows.collect()) == ['b"', "c"] and rejected.count() == 1  # the record is two lines


def test_large_files_are_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "".join(f"n{k},{k},1.5,y,z\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows, _ = tables.read_checked(spark, str(tmp_path / "a.csv"), tables.SALES_1399)
        assert rows.rdd.getNumPartitions() > 3 and rows.agg(F.sum("sale_count")).first()[0] == 20_000 * 19_999 // 2
        assert tables.read_table(spark, str(tmp_path / "a.csv"), tables.SALES_1399).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_plain_read_fails_on_a_record_that_does_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "x,three,1.5,y,z\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        tables.read_table(spark, str(tmp_path / "a.csv"), tables.SALES_1399).collect()


def test_files_of_other_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("کد ژنریک,تعداد در بسته,استان\n7,3,p\n")
    (tmp_path / "b2.csv").write_text("تعداد در بسته,new,کد ژنریک\n5,q,8\n")
    df = tables.read_shipments(spark, [str(tmp_path / "a1.csv"), str(tmp_path / "b2.csv")])
    assert {(r.generic_code, r.units_per_package, r.new, r.part) for r in df.collect()} == {("7", 3, None, 1), ("8", 5, "q", 2)}


def test_age_file_is_cast_by_what_it_holds(spark, tmp_path):
    """The layout of the committed files: names with line ends, grouped counts, percents."""
    (tmp_path / "a.csv").write_text(
        'Country,Total number of hemophilia A patients,0-4,5-13,14-18,19-44,45+,Age not known\nAlbania,220,0%,10%,5%,58%,27%,0%\n'
        'Algeria,"2,124",4%,14 %,15%,57%,11%,0%\n"New\nLand",,x,1,1%,1%,1%,100%\n'
    )
    df = spark.read.csv(str(tmp_path / "a.csv"), header=True, multiLine=True)
    kinds = {r.column: r for r in profiles.column_profile(df, ("Country",)).collect()}
    assert {c: r.kind for c, r in kinds.items()} == {
        "Country": "text", "Total number of hemophilia A patients": "whole",
        **dict.fromkeys(["0-4", "5-13", "14-18", "19-44", "45+", "Age not known"], "share"),
    }
    r = kinds["0-4"]
    assert (r["values"], r.percents, r.shares, r.numbers) == (3, 2, 2, 0) and kinds["Total number of hemophilia A patients"].separated == 1
    out = profiles.cast_by_content(df, ("Country",)).collect()
    assert [tuple(r)[1:4] for r in out] == [(220, 0.0, 0.1), (2124, 0.04, 0.14), (None, None, 0.01)]


def test_profile_of_other_columns(spark):
    df = spark.createDataFrame([(1, "1,5.5", "-", None), (2, "7", "", None)], "n int, a string, b string, `c.d` string")
    assert {r.column: (r.kind, r.numbers) for r in profiles.column_profile(df).collect()} == {"a": ("decimal", 2), "b": ("text", 0), "c.d": ("text", 0)}
    assert [r.a for r in profiles.cast_by_content(df).collect()] == [15.5, 7.0]
    assert profiles.column_profile(df.select("n")).collect() == []
    empty = {r.column: r.kind for r in profiles.column_profile(df.limit(0)).collect()}
    assert empty == {"a": "text", "b": "text", "c.d": "text"}
    scan = plan(profiles.column_profile(df))
    assert "Python" not in scan and scan.count("Scan ExistingRDD") == 1


def test_sales_are_saved_in_one_pass(spark, tmp_path):
    kind = "active_ingredient string, generic_name string, count_of_package_sold long, sale_count long, sale_amount double, otc string"
    first = spark.createDataFrame([("Factor VIII", "human", 2, 3, 5.0, "x"), ("Factor VIII", "Recombinant", 1, 2, 9.0, "x"), ("other", "human", 1, 1, 1.0, "x"), (None, None, 1, 1, 1.0, "x")], kind)
    second = first.filter("generic_name = 'human'")
    counts = sinks.save_sales_once(first, second, str(tmp_path / "once"))
    assert counts == {
        "rows_1400": 4, "factor_rows_1400": 2, "recombinant_rows_1400": 1, "rows_1399": 2, "factor_rows_1399": 1, "recombinant_rows_1399": 0,
    }
    sinks.save_sales(first, second, str(tmp_path / "four"))
    every = spark.read.parquet(str(tmp_path / "once"))
    for name in ("dataset", "1400", "1399", "recombinant_1400"):
        want = spark.read.parquet(str(tmp_path / "four" / name))
        got = every.filter(F.col("dataset").cast("string") == name).select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    n = every.count()
    sinks.save_sales_once(first, second, str(tmp_path / "once"))  # again
    assert spark.read.parquet(str(tmp_path / "once")).count() == n


def test_merged_rows_of_a_hot_key(spark):
    """A third of the rows have one key; its rows are written out in pieces, by more than one task."""
    left = [("hot", None)] * 500 + [(f"k{k}", k) for k in range(900)] + [(None, None)] * 3
    right = [("hot", None)] * 400 + [(f"k{k}", k) for k in range(850, 1000)] * 2 + [(None, None)] * 2
    a = spark.createDataFrame(left, "k string, v int").withColumn("x", F.lit(1))
    b = spark.createDataFrame(right, "k string, v int").withColumn("y", F.lit(1)).select("v", "y", "k")
    merged = sales.merge_common_columns(a, b, piece=1000)
    n, m = Counter(left), Counter(right)
    want = {k: max(n[k], 1) * max(m[k], 1) for k in n | m}
    assert Counter(map(tuple, merged.collect())) == want
    tasks = merged.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 150_000
    assert "Join" not in plan(merged)


def test_sketches_come_near_the_exact_numbers(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("part"), F.when(F.col("id") % 3 > 0, F.col("id") % 9000).alias("code"), F.lit(None).cast("string").alias("none"))
    exact = {r.part: r for r in sales.part_profile(df, "part", "code", ["code", "none"]).collect()}
    for r in sales.sketched_profile(df, "part", "code", ["code", "none"]).collect():
        assert abs(r.about_code - exact[r.part].different_code) <= 0.05 * exact[r.part].different_code
        assert (r.about_none, r.n_code, r.n_rows) == (1, exact[r.part].n_code, exact[r.part].n_rows)
    two = df.withColumn("other", F.col("code") % 5)
    assert "Expand" not in plan(sales.sketched_profile(two, "part", "code", ["code", "other"]))
    assert "Expand" in plan(sales.part_profile(two, "part", "code", ["code", "other"]))  # a row for each counted column


def test_overall_consumption(spark):
    rows = [(1, "x 10 [iU]", 2), (1, "x 10 [iU]", 3), (1, "no dose", 5), (2, "y 4 [iU]", 1), (2, None, None)]
    df = spark.createDataFrame(rows, "part int, name string, units long")
    total = lambda whole: sales.overall_consumption(sales.unit_consumption(df, "part", "name", "units", whole)).first()[0]
    assert (total(False), total(True)) == (54, 104)
    assert sales.overall_consumption(sales.unit_consumption(df.limit(0), "part", "name", "units")).first()[0] == 0


def records(spark, html):
    return html_fields.records(html_fields.label_values(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()


def test_deeply_nested_listings_take_linear_time(spark):
    deep = 50_000
    html = '<div class="searchRow"><div class="row">' + "<div><b>t" * deep + "<label>کد ژنریک</label><span>7" + "</b></div>" * 10
    start = time.perf_counter()
    parser = html_fields._Listing()
    parser.feed(html)
    parser.close()
    assert len(parser.found) == deep and set(parser.found) == {(0, "کد ژنریک", "7")}
    assert time.perf_counter() - start < 20
    (row,) = records(spark, html.replace("<b>t", "<b>", deep // 2))
    assert row.generic_code == "7"


def test_stray_ends_are_ignored(spark):
    (row,) = records(spark, '</div></p><div class="searchRow"></span><div class="row"><div></b><label>x صاحب برند</label></i><span>v</span></div></div></div></div>')
    assert row.brand == "v"


RATES = "regime string, abr double, ajbr double, albr double, eabr double, inhibitor_risk double, progression_risk double"


def test_rules_are_scaled_down_where_they_sum_to_more_than_what_is_left(spark):
    rates = spark.createDataFrame([("calm", 4.0, 1.0, 0.2, 1.0, 0.004, 0.0004), ("harsh", 10.0, 40.0, 30.0, 50.0, 0.01, 0.001)], RATES)
    rules = dim.transition_rules(spark, rates).filter("from_state = 'alive_wo_arthropathy'").collect()
    total = {r: sum(x.prob for x in rules if x.regime == r) for r in ("calm", "harsh")}
    assert total["harsh"] == pytest.approx(1.0) and total["calm"] < 1
    states = dim.stage_states(spark).crossJoin(rates.select("regime"))
    fixed = matrix.normalise_rows(matrix.dense_grid(dim.transition_rules(spark, rates), states, ["regime", "stage"]), ["regime", "stage"], matrix.repair_policy(spark))
    matrix.assert_valid(fixed, states, ["regime", "stage"])
    assert fixed.select("regime", "stage").distinct().count() == 6


def test_only_stale_and_missing_scenarios_are_written(spark, tmp_path):
    keys, path = ["regime", "stage"], str(tmp_path / "store")
    names = [(r, s) for r in ("a", "b") for s in ("x", "y")]
    states = spark.createDataFrame([(r, s, k, t) for r, s in names for k, t in enumerate("uv")], "regime string, stage string, ord int, state string")
    table = lambda p, which=names: spark.createDataFrame(
        [(r, s, f, t, p if f == t else 1 - p) for r, s in which for f in "uv" for t in "uv"], "regime string, stage string, from_state string, to_state string, prob double"
    )
    held = lambda: {(r.regime, r.stage, r.from_state, r.to_state): r.prob for r in scenarios.stored_scenarios(spark, path, states, keys).collect()}
    assert scenarios.stored_scenarios(spark, path, states, keys) is None
    scenarios.refresh_scenarios(spark, path, table(0.25), states, keys)
    assert len(held()) == 16 and set(held().values()) == {0.25, 0.75}

    # one scenario loses a state, another one as a whole; one that isn't wanted any more is left alone
    damaged = table(0.25).filter("not (regime = 'a' and stage = 'x' and to_state = 'v') and not (regime = 'b' and stage = 'y')")
    damaged = damaged.union(spark.createDataFrame([("old", "x", "u", "u", 1.0)], table(0.5).schema))
    other = str(tmp_path / "damaged")
    damaged.write.partitionBy(*keys).parquet(other)
    path = other
    status = {(r.regime, r.stage): r.status for r in scenarios.scenario_status(damaged, states, keys).collect()}
    assert status == {("a", "x"): "stale", ("a", "y"): "stored", ("b", "x"): "stored", ("b", "y"): "missing"}
    merged = scenarios.kept_or_new(damaged, table(0.5), states, keys).collect()
    assert Counter((r.regime, r.stage, r.status, r.prob == 0.5) for r in merged) == {
        ("a", "x", "stale", True): 4, ("a", "y", "stored", False): 4, ("b", "x", "stored", False): 4, ("b", "y", "missing", True): 4,
    }
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "damaged").glob("regime=*/stage=*/*.parquet")}
    scenarios.refresh_scenarios(spark, path, table(0.5), states, keys)
    now = held()
    assert {now[r, s, "u", "u"] for r, s in (("a", "x"), ("b", "y"))} == {0.5} and {now[r, s, "u", "u"] for r, s in (("a", "y"), ("b", "x"))} == {0.25}
    assert len(now) == 17 and now["old", "x", "u", "u"] == 1.0
    kept = [p for p in untouched if p.exists()]
    assert {p.parent.parent.name + "/" + p.parent.name for p in kept} >= {"regime=a/stage=y", "regime=b/stage=x", "regime=old/stage=x"}
    scenarios.refresh_scenarios(spark, path, table(0.5), states, keys)  # nothing is due
    assert held() == now
    scenarios.refresh_scenarios(spark, path, table(0.75), states, keys, override=True)
    assert {v for k, v in held().items() if k[0] != "old"} == {0.75, 0.25}
    with pytest.raises(ValueError, match="transition table"):
        scenarios.refresh_scenarios(spark, path, table(0.75).filter("to_state = 'u'"), states, keys, override=True)


def test_status_without_a_store(spark):
    states = spark.createDataFrame([("s", 0, "u")], "scenario string, ord int, state string")
    new = spark.createDataFrame([("s", "u", "u", 1.0)], "scenario string, from_state string, to_state string, prob double")
    assert [tuple(r) for r in scenarios.kept_or_new(None, new, states, ["scenario"]).collect()] == [("s", "u", "u", 1.0, "missing")]
    assert "Python" not in plan(scenarios.kept_or_new(new, new, states, ["scenario"]))
