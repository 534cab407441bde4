"""Queries through files and readers: round trips, one-pass results, column profiles and listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import profiles, sales
from cohortry.plans.sales_queries import _NAMED, _factors, _named, _shipped, _sold_parts
from cohortry.sources import html_fields, sinks, tables
from cohortry.sources.folders import new_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def checked_sales(spark: SparkSession, d: str) -> DataFrame:
    """All sold lines written as a sales file with its original headers and read back: sums by brand and by product
    family of the rows that fit the schema, and what was rejected. Some counts are no numbers, some amounts are missing."""
    line = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cells = {
        "brand_owner": F.col("p_brand"), "generic_name": F.concat(F.col("p_name"), F.lit(', "new"  ')), "active_ingredient": F.col("p_type"),
        "sale_count": F.when(F.col("l_orderkey") % 89 == 0, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string")),
        "sale_amount": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice").cast("string")),
        "count_in_package": F.when(F.col("l_orderkey") % 97 == 0, "1.5").otherwise(F.col("p_size").cast("string")),
    }
    headers = {ours: header for header, ours in tables.SALES_1399.items()}
    path = new_path(spark, "sales-csv")
    line.select(*[c.alias(headers[n]) for n, c in cells.items()]).write.csv(path, header=True, escape='"', ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    rows, rejected = tables.read_checked(spark, path, tables.SALES_1399, ("generic_name", "sale_count", "sale_amount"))
    good = rows.groupBy("brand_owner", "generic_name").agg(
        F.count("*").alias("n_rows"), F.sum("sale_count").alias("sale_count"), F.round(F.coalesce(F.sum("sale_amount"), F.lit(0.0)), 2).alias("sale_amount"),
        F.sum("count_in_package").alias("packed"),
    )
    bad = rejected.groupBy(F.col("first_cell").alias("brand_owner")).agg(F.count("*").alias("n_rows"))
    return good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)), allowMissingColumns=True)


CHECKED_SALES = """
WITH s AS (SELECT p_brand, p_name || ', "new"  ' AS g, l_quantity::BIGINT AS q, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice::DOUBLE END AS a, p_size,
    l_orderkey % 89 = 0 OR l_orderkey % 97 = 0 AS bad FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand AS brand_owner, g AS generic_name, count(*) AS n_rows, sum(q)::BIGINT AS sale_count, round(coalesce(sum(a), 0), 2) AS sale_amount, sum(p_size)::BIGINT AS packed, false AS rejected
FROM s WHERE NOT bad GROUP BY 1, 2
UNION ALL SELECT p_brand, NULL, count(*), NULL, NULL, NULL, true FROM s WHERE bad GROUP BY 1
"""


def saved_sales(spark: SparkSession, d: str) -> DataFrame:
    """The yearly flow's four tables as one stored table, written in one job and read back, and the counts that were taken
    on the way."""
    rows = _factors(spark, d).join(_sold_parts(spark, d), F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey", "p_partkey", "place")
    path = new_path(spark, "saved-sales")
    counts = sinks.save_sales_once(rows, rows.filter("sale_count > 100"), path)
    back = spark.read.parquet(path).select(
        F.col("dataset").cast("string").alias("dataset"), "generic_name", "count_of_package_sold", "sale_count",
        F.col("sale_amount").cast("double").alias("sale_amount"), "n_rows", F.col("price_per_package").cast("double").alias("price_per_package"),
    )
    taken = spark.createDataFrame(sorted(counts.items()), "dataset string, n_rows long")
    return back.unionByName(taken, allowMissingColumns=True)


SAVED_SALES = """
WITH s AS (SELECT l_partkey, count(*) AS packages, sum(l_quantity::BIGINT)::BIGINT AS n, sum(l_extendedprice::DECIMAL(18,2)) AS a FROM lineitem GROUP BY 1),
p AS (SELECT packages, n, a,
    CASE WHEN p_size % 5 = 0 THEN 'Factor VIII + von Willebrand' WHEN p_size % 7 <> 0 THEN 'Factor VIII ' || p_type END AS i,
    CASE WHEN p_size % 3 = 0 THEN 'RECOMBINANT ' || p_name WHEN p_size % 3 = 1 THEN p_name END AS g FROM part JOIN s ON p_partkey = l_partkey),
m AS (SELECT *, coalesce(contains(lower(i), 'factor viii') AND NOT contains(lower(i), 'von willebrand'), false) AS f, coalesce(contains(lower(g), 'recombinant'), false) AS r FROM p),
human AS (SELECT g, NULL::BIGINT AS packages, sum(n)::BIGINT AS n, sum(a) AS a, count(*) AS rows, (sum(a) / nullif(sum(n), 0))::DOUBLE AS price FROM m WHERE f AND NOT r AND g IS NOT NULL GROUP BY g),
rec AS (SELECT g, packages, n, a, NULL::BIGINT AS rows, (a / nullif(n, 0))::DOUBLE AS price FROM m WHERE f AND r),
later AS (SELECT g, sum(packages)::BIGINT AS packages, NULL::BIGINT AS n, sum(a) AS a, count(*) AS rows, (sum(a) / nullif(sum(packages), 0))::DOUBLE AS price FROM m WHERE f AND n > 100 AND g IS NOT NULL GROUP BY g),
u AS (SELECT '1400' AS dataset, * FROM human UNION ALL SELECT 'recombinant_1400', * FROM rec UNION ALL SELECT '1399', * FROM later
    UNION ALL SELECT 'dataset', g, NULL, n, a, NULL, price FROM human UNION ALL SELECT 'dataset', g, NULL, n, a, NULL, price FROM rec),
c AS (SELECT unnest(['rows_1400', 'factor_rows_1400', 'recombinant_rows_1400', 'rows_1399', 'factor_rows_1399', 'recombinant_rows_1399']) AS dataset,
    unnest([count(*), count(*) FILTER (f), count(*) FILTER (f AND r), count(*) FILTER (n > 100), count(*) FILTER (f AND n > 100), count(*) FILTER (f AND r AND n > 100)]) AS rows FROM m)
SELECT dataset, g AS generic_name, packages AS count_of_package_sold, n AS sale_count, a::DOUBLE AS sale_amount, rows AS n_rows, round_even(price, 0)::DOUBLE AS price_per_package FROM u
UNION ALL SELECT dataset, NULL, NULL, NULL, NULL, rows, NULL FROM c
"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as an age file has them: percents, grouped numbers, decimals and names, some cells empty or odd."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_orderkey")
    thousands = F.concat(F.floor(k / 1000).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))
    return _t(spark, d, "lineitem").select(
        F.when(k % 5 == 0, F.concat(q.cast("string"), F.lit(" %"))).when(k % 5 == 1, "unknown").otherwise(q.cast("string")).alias("0-4"),
        F.when(k % 11 == 0, "-").when(k % 13 != 0, F.when(k < 1000, k.cast("string")).otherwise(thousands)).alias("patients"),
        F.concat(q.cast("string"), F.lit(".25")).alias("dose"), F.col("l_returnflag").alias("Country"), q.cast("string").alias("code"),
        F.translate(q.cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹").alias("persian"), F.lit(None).cast("string").alias("empty"),
    )


def text_profile(spark: SparkSession, d: str) -> DataFrame:
    """What the text columns hold, and the sums of their casts."""
    df = _texts(spark, d)
    found = profiles.column_profile(df, ("code",))
    numbers = profiles.cast_by_content(df, ("code",))
    cells = [F.struct(F.lit(c).alias("name"), F.round(F.sum(F.col(f"`{c}`").cast("double")), 4).alias("total")) for c, k in numbers.dtypes if k != "string"]
    sums = numbers.agg(F.array(*cells).alias("a")).select(F.inline("a"))
    return found.join(F.broadcast(sums), F.col("column") == F.col("name"), "left").drop("name")


TEXT_PROFILE = """
WITH l AS (SELECT l_quantity::BIGINT AS q, l_orderkey AS k, l_returnflag AS m FROM lineitem),
a AS (SELECT count(*) AS n, count(*) FILTER (k % 5 = 0) AS pct, count(*) FILTER (k % 5 <> 1) AS shares, count(*) FILTER (k % 5 > 1) AS plain,
    sum(q) FILTER (k % 5 <> 1) / 100.0::DOUBLE AS share, count(*) FILTER (k % 11 = 0) AS dash, count(*) FILTER (k % 11 <> 0 AND k % 13 <> 0) AS num,
    count(*) FILTER (k % 11 <> 0 AND k % 13 <> 0 AND k >= 1000) AS sep, count(*) FILTER (k % 11 <> 0 AND k % 13 <> 0 AND k < 1000) AS small,
    sum(k) FILTER (k % 11 <> 0 AND k % 13 <> 0)::DOUBLE AS ks, sum(q)::DOUBLE AS qs FROM l)
SELECT '0-4' AS "column", 'share' AS kind, n AS "values", pct AS percents, shares, plain AS numbers, plain AS wholes, 0::BIGINT AS separated, round(share, 4) AS total FROM a
UNION ALL SELECT 'patients', 'whole', num + dash, 0, small, num, num, sep, ks FROM a
UNION ALL SELECT 'dose', 'decimal', n, 0, n, n, 0, 0, round(qs + 0.25 * n, 4) FROM a
UNION ALL SELECT 'Country', 'text', (SELECT count(m) FROM l), 0, 0, 0, 0, 0, NULL FROM a
UNION ALL SELECT 'code', 'text', n, 0, n, n, n, 0, NULL FROM a
UNION ALL SELECT 'persian', 'whole', n, 0, n, n, n, 0, qs FROM a
UNION ALL SELECT 'empty', 'text', 0, 0, 0, 0, 0, 0, NULL FROM a
"""

_LISTING = (
    '<div class="searchRow"><span class="titleSearch-Link-RtlAlter"><a>پ{id}</a><a>late</a></span>'
    '<span class="titleSearch-Link-ltrAlter"><a> Factor {id} </a></span><div class="row"><div><label>صاحب برند:</label><span>b{id}</span></div>'
    '<div><label>قیمت هر بسته</label><bdo>{price}</bdo><span>x</span></div><div><label>کد ژنریک</label><span><b>{id}</b>7</span></div></div></div>'
)
_SECOND = (
    '<div class="searchRow"><span class="titleSearch-Link-ltrAlter"><a>alone</a></span><div class="row"><div><label>صاحب پروانه</label>'
    "<span>{url}</span></div><div><label>صاحب پروانه</label><span>o{id}</span><div class=row><div><label>بسته بندی</label><span>inner"
)


def listing_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of two listing blocks around each page's own markup; the second block has one title and open elements."""
    def filled(html: str):
        # the page's own parts as text cells: its number, its price and its address
        cells = {"{id}": F.col("page_id").cast("string"), "{price}": (F.col("page_id") * 1000).cast("string"), "{url}": F.replace("url", F.lit("&"), F.lit("&amp;"))}
        out = F.lit(html)
        for mark, cell in cells.items():
            out = F.replace(out, F.lit(mark), cell)
        return out

    pages = _t(spark, d, "pages").filter("url is not null")
    html = F.concat(filled(_LISTING), F.lit("<p>"), F.coalesce("html", F.lit("")), F.lit("</p>"), filled(_SECOND))
    found = html_fields.label_values(pages.select("page_id", html.alias("html")))
    return html_fields.records(found)


LISTING_RECORDS = """
SELECT page_id, 0 AS block_no, 'پ' || page_id AS persian_name, 'Factor ' || page_id AS english_name, 'b' || page_id AS brand, 'N/A' AS owner, (page_id * 1000)::VARCHAR AS price,
       'N/A' AS dosage_form, 'N/A' AS code, page_id || '7' AS generic_code FROM pages WHERE url IS NOT NULL
UNION ALL SELECT page_id, 1, 'N/A', 'N/A', 'N/A', 'o' || page_id, 'N/A', 'inner', 'N/A', 'N/A' FROM pages WHERE url IS NOT NULL
"""


def overall_consumption(spark: SparkSession, d: str) -> DataFrame:
    """The sum over all parts and names, by rows and with each name's dose times its whole part's units."""
    both = [
        sales.overall_consumption(sales.unit_consumption(_shipped(spark, d), "part", "generic_name", "units", whole)).withColumn("whole_part", F.lit(whole))
        for whole in (False, True)
    ]
    return both[0].union(both[1])


OVERALL_CONSUMPTION = f"""
WITH {_NAMED}, s AS (SELECT part, generic_name, sum(l_quantity::BIGINT)::BIGINT AS units FROM lineitem JOIN n ON l_partkey = p_partkey WHERE part <> 2 GROUP BY ALL),
t AS (SELECT *, sum(units) OVER (PARTITION BY part) AS whole, regexp_extract(generic_name, '([0-9]+)\\s*\\[iU\\]', 1) AS dose FROM s)
SELECT coalesce(sum(dose::BIGINT * units), 0)::BIGINT AS total_iu, false AS whole_part FROM t WHERE generic_name LIKE '%[iU]'
UNION ALL SELECT coalesce(sum(dose::BIGINT * whole), 0)::BIGINT, true FROM t WHERE generic_name LIKE '%[iU]'
"""


def sketched_parts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of different values by part, exact and whether the sketches come within 5 % of them."""
    named = _named(spark, d).withColumn("code", F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    names = ["generic_name", "code", "p_brand"]
    exact = sales.part_profile(named, "part", "code", names)
    about = sales.sketched_profile(named, "part", "code", names).drop("n_code", "n_rows").withColumnRenamed("part", "of")
    near = [(F.abs(F.col(f"about_{c}") - F.col(f"different_{c}")) <= 0.05 * F.col(f"different_{c}")).alias(f"near_{c}") for c in names]
    return exact.join(about, F.col("part").eqNullSafe(F.col("of"))).select("part", "n_rows", *[f"different_{c}" for c in names], *near)


SKETCHED_PARTS = f"""
WITH {_NAMED}, c AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size END AS code FROM n)
SELECT part, count(*) AS n_rows, count(DISTINCT generic_name) + max((generic_name IS NULL)::BIGINT) AS different_generic_name,
       count(DISTINCT code) + max((code IS NULL)::BIGINT) AS different_code, count(DISTINCT p_brand) + max((p_brand IS NULL)::BIGINT) AS different_p_brand,
       true AS near_generic_name, true AS near_code, true AS near_p_brand
FROM c GROUP BY part
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (checked_sales, CHECKED_SALES), (saved_sales, SAVED_SALES), (text_profile, TEXT_PROFILE), (listing_records, LISTING_RECORDS),
        (overall_consumption, OVERALL_CONSUMPTION), (sketched_parts, SKETCHED_PARTS),
    )
}
