"""Readers and writers of whole files, listing pages, start checks, plain rewards and the 2023 flow."""

import pytest
from pyspark.sql import functions as F

from cohortry.functions.body import growth_weight
from cohortry.operators import distribution as dist
from cohortry.operators import flows, matrix, paths, sensitivity
from cohortry.sources import dimensions as dim
from cohortry.sources import html_fields, sinks, tables


def write_csv(path, header, *lines):
    quoted = [",".join('"' + str(c).replace('"', '""') + '"' if c is not None else "" for c in line) for line in (header, *lines)]
    path.write_text("\n".join(quoted) + "\n")
    return str(path)


def test_read_sales_of_both_years(spark, tmp_path):
    first = [f"v{k}" for k in range(len(tables.SALES_1400))]
    line = dict(zip(tables.SALES_1400.values(), first, strict=True)) | {"sale_count": "12", "count_in_package": None, "count_of_package_sold": "3", "sale_amount": "1.5"}
    a = write_csv(tmp_path / "a.csv", tables.SALES_1400, line.values())
    other = dict.fromkeys(tables.SALES_1399.values(), "x") | {"sale_count": "7", "count_in_package": "2", "count_of_package_sold": "9", "sale_amount": "8"}
    b = write_csv(tmp_path / "b.csv", tables.SALES_1399, other.values())
    got_a, got_b = tables.read_sales(spark, a, b)
    assert got_a.columns == list(tables.SALES_1400.values()) and got_b.columns == list(tables.SALES_1399.values())
    assert got_a.schema["sale_count"].dataType.typeName() == "long" and got_a.schema["sale_amount"].dataType.typeName() == "double"
    assert got_a.first().asDict() == line | {"sale_count": 12, "count_in_package": None, "count_of_package_sold": 3, "sale_amount": 1.5}
    assert (got_b.first().sale_count, got_b.first().sale_amount, got_b.first().irc) == (7, 8.0, "x")


def test_read_sales_2023_and_its_flow(spark, tmp_path):
    names = list(tables.SALES_2023.values())

    def line(generic, brand, packages, count, amount, code):
        row = dict.fromkeys(names, None) | {
            "generic_name": generic, "brand_latin_name": brand, "count_of_package_sold": packages, "sale_count": count,
            "sale_amount": amount, "irc_code": code,
        }
        return [row[n] for n in names]

    path = write_csv(
        tmp_path / "s.csv", tables.SALES_2023, line("FACTOR VIII 500 IU", "BRAND A  500", 1, 10, 5.0, "1"), line("factor viii 250", "BRAND A  500", 2, 20, 6.0, "2"),
        line("Factor IX 500", "OTHER  1", 3, 3, 3.0, "3"), line("factor x", "lower  2", 4, 4, 4.0, "4"), line(None, "NO NAME  9", 1, 1, 1.0, "5"),
        line("Factor VIII 1000", "Solo", 7, 70, 7.5, "6"),
    )
    sales = tables.read_sales_2023(spark, path)
    assert sales.columns == names
    assert sorted(r.brand_latin_name for r in tables.factor_names(sales).collect()) == ["BRAND A  500", "BRAND A  500", "Solo", "lower  2"]
    out = flows.tables_2023(sales, ["irc_code"])
    assert sorted((r.brand_latin_name, r.irc_code) for r in out["dataset"].collect()) == [("BRAND A  500", "1"), ("Solo", "6"), ("lower  2", "4")]
    prices = {r.brand_latin_name: (r.generic_name, r.count_of_package_sold, r.sale_count, r.sale_amount, r.dosage) for r in out["prices"].collect()}
    assert prices == {"BRAND A": ("FACTOR VIII 500 IU", 3, 30, 11.0, 500), None: ("Factor VIII 1000", 7, 70, 7.5, 1000)}


def test_read_summary(spark, tmp_path):
    path = write_csv(tmp_path / "s.csv", ["generic_name", "count 1403"], ["a 5", "12"], ["b", None])
    assert sorted((r.generic_name, r.sale_count) for r in tables.read_summary(spark, path, "count 1403").collect()) == [("a 5", 12), ("b", None)]


def test_matrix_is_stored_and_read_back(spark, tmp_path):
    long = spark.createDataFrame([("s", "x", "x", 0.25), ("s", "x", "y", 0.75), ("s", "y", "y", 1.0)], "scenario string, from_state string, to_state string, prob double")
    sinks.save_matrix(long, ["x", "y"], str(tmp_path / "m"))
    wide = spark.read.csv(str(tmp_path / "m"), header=True, inferSchema=True)
    assert sorted(map(tuple, wide.collect())) == [("s", "x", 0.25, 0.75), ("s", "y", 0.0, 1.0)]
    back = tables.read_wide_matrix(wide.drop("scenario").withColumnRenamed("from_state", "States"), "s")
    assert sorted(map(tuple, back.collect())) == [("s", 0, "x", "x", 0.25), ("s", 0, "x", "y", 0.75), ("s", 1, "y", "x", 0.0), ("s", 1, "y", "y", 1.0)]


def fields(spark, html):
    return {r.block_no: r for r in html_fields.records(html_fields.label_values(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()}


def test_an_inner_div_overwrites_its_outer_one(spark):
    html = """<div class="searchRow"><div class="row">
    <div><span>x</span><div><label>صاحب برند</label><span>y</span></div></div>
    <div><label>کد ژنریک</label><span><b>1</b><span>2</span></span><span>3</span></div>
    <div class="row"><div><label>قیمت هر بسته</label><bdo>inner</bdo></div></div><div><label>قیمت هر بسته</label><bdo>outer</bdo></div>
    </div></div>"""
    got = fields(spark, html)[0]
    assert (got.brand, got.generic_code, got.price) == ("y", "12", "inner")


def test_open_elements_are_closed_at_the_end(spark):
    got = fields(spark, '<div class="searchRow row"><div><label>کد فرآورده</label><span>no row around it</span></div><div class=row><div><label>صاحب پروانه<span>z')
    assert (got[0].owner, got[0].code) == ("z", "N/A")
    pages = spark.createDataFrame([(1, "<h1>open <b>text"), (2, "</h1>")], "page_id long, html string")
    assert [tuple(r) for r in html_fields.label_values(pages, ["h1"]).collect()] == [(1, 0, 0, "h1", "open text")]


def test_titles_are_of_their_block(spark):
    row = '<div class="searchRow"><span class="titleSearch-Link-RtlAlter"><a>{0}</a><a>late</a></span><span class="titleSearch-Link-ltrAlter"><a>{1}</a></span><div class="row"><div><label>x</label><span>y</span></div></div></div>'
    got = fields(spark, row.format("a", "b") + row.format("c", "d"))
    assert {k: (r.persian_name, r.english_name, r.brand) for k, r in got.items() } in ({0: ("a", "b", "N/A"), 1: ("c", "d", "N/A")},)


def test_start_states_and_initial_probabilities(spark):
    states = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y")], "scenario string, ord int, state string")
    long = spark.createDataFrame([("s", a, b, 0.5) for a in "xy" for b in "xy"], "scenario string, from_state string, to_state string, prob double")
    start = lambda *names: spark.createDataFrame([("s", n) for n in names], "scenario string, state string")
    initial = lambda *p: spark.createDataFrame([("s", *x) for x in p], "scenario string, state string, prob double")
    matrix.assert_valid(long, states, ["scenario"], start("x"), initial(("x", 0.25), ("y", 0.75)))
    with pytest.raises(ValueError, match="start"):
        matrix.assert_valid(long, states, ["scenario"], start("z"))
    with pytest.raises(ValueError, match="initial"):
        matrix.assert_valid(long, states, ["scenario"], initial=initial(("x", 0.5)))
    found = matrix.initial_violations(initial(("x", 0.5), ("z", 0.5)), states, ["scenario"]).collect()
    assert [tuple(r) for r in found] == [("s", "z", "start")]


def test_plain_rewards(spark):
    p = spark.createDataFrame([(r, k, s) for r in range(3) for k, s in enumerate(["minor", "other", "MAJOR"])], "run_id int, step int, state string")
    rewards = {"plain": paths.plain_reward(lambda step, state: step * 10 + len(state)), "built_in": paths.on_demand_consumption}
    got = paths.add_rewards(p, rewards).collect()
    assert all(r.plain == r.step * 10 + len(r.state) for r in got)
    weight = spark.range(1).select(growth_weight(F.lit(2))).first()[0]
    assert {r.built_in for r in got if r.step == 2} == {weight * 90}
    assert [r.plain for r in paths.add_rewards(p, rewards, "reference").filter("run_id = 0").orderBy("step").collect()] == [5, 5, 15]


def test_stored_table_is_built_anew_where_states_differ(spark):
    states = spark.createDataFrame([("x",), ("y",)], "state string")
    table = lambda *to: spark.createDataFrame([("x", t, 1.0) for t in to], "from_state string, to_state string, prob double")
    new = table("x", "y")
    assert matrix.stored_or_new(table("x"), new, states) is new
    assert matrix.stored_or_new(table("x", "y", "z"), new, states) is new
    assert matrix.stored_or_new(table("x", "y"), new, states, override=True) is new
    assert matrix.stored_or_new(table().limit(0), new, states) is new


def test_treatment_constants(spark):
    got = {r.regime: (r.albr, r.eabr) for r in dim.treatments(spark).collect()}
    assert got["on_demand"] == (2.0, 8.0) and got["prophylaxis"] == pytest.approx((0.1692, 0.564))


def test_sobol_of_incomplete_rows(spark):
    """Rows that lack an evaluation count for the mean only."""
    rows = [(1.0, 2.0, 2.5), (3.0, 1.0, 0.5), (2.0, 4.0, 1.5), (9.0, None, 1.0)]
    (got,) = sensitivity.sobol_of_rows(spark.createDataFrame(rows, "a double, b double, ab double"), "a", "b", ["ab"]).collect()
    every = [v for r in rows for v in r if v is not None]
    m = sum(every) / len(every)
    full = rows[:3]
    both = [v for r in full for v in r[:2]]
    var = sum(v * v for v in both) / 6 - (sum(both) / 6) ** 2
    assert got.s1 == pytest.approx(sum((b - m) * (ab - a) for a, b, ab in full) / 3 / var)
    assert got.st == pytest.approx(sum((a - ab) ** 2 for a, b, ab in full) / 6 / var)
    assert sensitivity.sobol_of_rows(spark.createDataFrame([], "a double, b double, ab double"), "a", "b", ["ab"]).collect() == []


def test_kernel_of_a_continuous_column(spark):
    v = [k * 0.0101 for k in range(900)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    fine, coarse = ([r.density for r in dist.kernel_density(df, "v", 0, 9, 0.3, step).orderBy("at").collect()] for step in (None, 0.05))
    assert coarse == pytest.approx(fine, abs=1e-3) and sum(coarse) == pytest.approx(1.0)
