"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import bench
from cohortry.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_headline_join_takes_every_order(spark, tmp_path):
    orders = [(k, k % 7, "OFP"[k % 3], float(k), None) for k in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    segment = {k: ["BUILDING", "MACHINERY"][k % 2] for k in range(7)}
    spark.createDataFrame(list(segment.items()), "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    (name,) = {n for n in bench.HEADLINE if n.startswith("common_")}
    held = Counter((c, None if segment[c] == "BUILDING" else segment[c], None if s == "O" else s) for _, c, s, *_ in orders)
    got = Counter(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == {k: n * n for k, n in held.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cells(rows, names):
    def cell(v):
        return f"{round(float(v), 9):g}" if isinstance(v, float) and not math.isnan(v) else str(v)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert cells(got, df.columns) == cells(rows, names)


def test_page_titles_equal_their_sql_on_odd_pages(spark, tmp_path):
    pages = {
        "<title>R&amp;amp;D &lt;b&gt; &amp</title><h1>cut&amp</h1><a>&eacute; &#65; &lt &nbsp</a>": ("R&amp;D <b> &amp", "cut&amp", "&eacute; &#65; &lt &nbsp"),
        "<TITLE>upper</TITLE><title>lower</title><h1>\u2003x\x0b\u00a0</h1><a\x0b>y</a>": ("lower", "\u2003x\x0b", "N/A"),
        "<h1>open <b>text<a>out<a href='>'>in</a></a>": ("N/A", "", "out'>in"),
        "<!-- <title>note</title> --><title>real</title><h1/><h1>a < b</h1><a": ("note", "a < b", "N/A"),
        "<h1><title>x</h1>y <i\n>z</title><abbr>no link</abbr>": ("xy z", "x", "N/A"),
        "<a <h1 <title": ("N/A", "N/A", "N/A"),
        "<b>none</b>": None, "": None, None: None,
    }
    # one key twice and a null key: each page is a row
    rows = [((1, 1, None)[k] if k < 3 else k, "u", html) for k, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = registry.QUERIES["page_titles"](spark, str(tmp_path))
    got = df.collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["page_titles"])
    names = [d[0] for d in want.description]
    assert cells(got, df.columns) == cells(want.fetchall(), names)
    assert Counter(map(tuple, got)) == Counter((key, *pages[html]) for key, _, html in rows if pages[html])
