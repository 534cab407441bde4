"""Sales and cleaning queries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions import text
from cohortry.operators import filters, flows, pyramid, sales


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sold(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with sale_count and sale_amount in exact decimals."""
    return _t(spark, d, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber",
        F.col("l_quantity").cast("long").alias("sale_count"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("sale_amount"),
    )


def _sold_parts(spark: SparkSession, d: str) -> DataFrame:
    """One row per sold part: rows, both sums, and the place of its first line (order key and line number in one number)."""
    place = F.col("l_orderkey").cast("decimal(20,0)") * F.lit(10_000_000_000) + F.col("l_linenumber")
    return _sold(spark, d).groupBy("l_partkey").agg(
        F.count("*").alias("count_of_package_sold"), F.sum("sale_count").alias("sale_count"),
        F.sum("sale_amount").alias("sale_amount"), F.min(place).alias("place"),
    )


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def _total(sold: DataFrame, key: str) -> DataFrame:
    out = sales.total_sales(sold.withColumnRenamed(key, "generic_name"))
    return _doubles(out, "sale_amount", "price_per_package").withColumnRenamed("generic_name", key)


def widget_sales(spark: SparkSession, d: str) -> DataFrame:
    part = filters.text_filter(_t(spark, d, "part"), [("p_name", "Widget")], [("p_name", "cold")])
    sold = _sold(spark, d).join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return _total(sold, "p_name").select("p_name", "sale_count", "sale_amount", "n_rows", "price_per_package")


WIDGET_SALES = """
SELECT p_name, sum(l_quantity::BIGINT)::BIGINT AS sale_count, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sale_amount,
       count(*) AS n_rows,
       round_even((sum(l_extendedprice::DECIMAL(18,2)) / nullif(sum(l_quantity::BIGINT), 0))::DOUBLE, 0)::DOUBLE AS price_per_package
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE contains(lower(p_name), 'widget') AND NOT contains(lower(p_name), 'cold') AND p_name IS NOT NULL GROUP BY p_name
"""


def _factors(spark: SparkSession, d: str) -> DataFrame:
    """Parts with names that stand in for the ingredient's and the generic's."""
    return _t(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 5 == 0, F.lit("Factor VIII + von Willebrand"))
        .when(F.col("p_size") % 7 != 0, F.concat(F.lit("Factor VIII "), F.col("p_type"))).alias("active_ingredient"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("RECOMBINANT "), F.col("p_name")))
        .when(F.col("p_size") % 3 == 1, F.col("p_name")).alias("generic_name"),
    )


def recombinant_split(spark: SparkSession, d: str) -> DataFrame:
    """Factor rows by recombinant or not."""
    both = [
        filters.factor_viii(_factors(spark, d), kind).select(F.lit(name).alias("kind"), "p_partkey", "active_ingredient", "generic_name")
        for kind, name in ((True, "recombinant"), (False, "other"))
    ]
    return both[0].unionByName(both[1])


RECOMBINANT_SPLIT = """
WITH p AS (SELECT p_partkey,
    CASE WHEN p_size % 5 = 0 THEN 'Factor VIII + von Willebrand' WHEN p_size % 7 <> 0 THEN 'Factor VIII ' || p_type END AS active_ingredient,
    CASE WHEN p_size % 3 = 0 THEN 'RECOMBINANT ' || p_name WHEN p_size % 3 = 1 THEN p_name END AS generic_name FROM part)
SELECT CASE WHEN coalesce(contains(lower(generic_name), 'recombinant'), false) THEN 'recombinant' ELSE 'other' END AS kind, *
FROM p WHERE coalesce(contains(lower(active_ingredient), 'factor viii'), false)
  AND NOT coalesce(contains(lower(active_ingredient), 'von willebrand'), false)
"""


def merged_sales(spark: SparkSession, d: str) -> DataFrame:
    """The yearly flow's dataset: human totals and recombinant rows on their common columns."""
    rows = _factors(spark, d).join(_sold_parts(spark, d), F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey", "p_partkey", "place")
    return _doubles(flows.sales_tables(rows, rows)["dataset"], "sale_amount", "price_per_package")


MERGED_SALES = """
WITH s AS (SELECT l_partkey, sum(l_quantity::BIGINT)::BIGINT AS sale_count, sum(l_extendedprice::DECIMAL(18,2)) AS sale_amount FROM lineitem GROUP BY 1),
p AS (SELECT sale_count, sale_amount,
    CASE WHEN p_size % 5 = 0 THEN 'Factor VIII + von Willebrand' WHEN p_size % 7 <> 0 THEN 'Factor VIII ' || p_type END AS active_ingredient,
    CASE WHEN p_size % 3 = 0 THEN 'RECOMBINANT ' || p_name WHEN p_size % 3 = 1 THEN p_name END AS generic_name FROM part JOIN s ON p_partkey = l_partkey),
f AS (SELECT * FROM p WHERE contains(lower(active_ingredient), 'factor viii') AND NOT contains(lower(active_ingredient), 'von willebrand')),
h AS (SELECT generic_name, sum(sale_count)::BIGINT AS sale_count, sum(sale_amount) AS sale_amount FROM f
      WHERE NOT contains(lower(generic_name), 'recombinant') GROUP BY 1),
u AS (SELECT * FROM h UNION ALL SELECT generic_name, sale_count, sale_amount FROM f WHERE contains(lower(generic_name), 'recombinant'))
SELECT generic_name, sale_count, sale_amount::DOUBLE AS sale_amount, round_even((sale_amount / nullif(sale_count, 0))::DOUBLE, 0)::DOUBLE AS price_per_package FROM u
"""


def other_factor_names(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    kinds = F.array(*[F.lit(k) for k in ("Factor VIIa ", "Factor IX ", "factor xiii ", "FACTOR VIII ", "Mix ", "factor ")])
    named = part.select("p_partkey", "p_brand", F.concat(F.get(kinds, F.col("p_size") % 6), F.col("p_name")).alias("generic_name"))
    return filters.other_factors(named)


OTHER_FACTOR_NAMES = """
WITH n AS (SELECT p_partkey, p_brand, ['Factor VIIa ', 'Factor IX ', 'factor xiii ', 'FACTOR VIII ', 'Mix ', 'factor '][p_size % 6 + 1] || p_name AS generic_name FROM part)
SELECT * FROM n WHERE contains(lower(generic_name), 'factor') AND NOT contains(lower(generic_name), 'viia')
  AND NOT contains(lower(generic_name), 'ix') AND NOT contains(lower(generic_name), 'xiii')
"""


def common_rows(spark: SparkSession, d: str) -> DataFrame:
    """All orders and all customers on the three columns that both have; a customer meets its orders of one status."""
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment")
    customer = _t(spark, d, "customer").select("c_custkey", segment, "c_acctbal")
    orders = _t(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    status = F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status")
    left = orders.select("segment", F.col("o_custkey").alias("custkey"), status, F.lit(1).alias("only_left"))
    status = F.when(F.col("c_acctbal") < 0, "F").alias("status")
    right = customer.select(F.lit(2).alias("only_right"), status, F.col("c_custkey").alias("custkey"), "segment")
    return sales.merge_common_columns(left, right)


COMMON_ROWS = """
WITH c AS (SELECT c_custkey AS custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_acctbal < 0 THEN 'F' END AS status FROM customer),
o AS (SELECT custkey, segment, nullif(o_orderstatus, 'O') AS status FROM orders JOIN c ON o_custkey = custkey)
SELECT coalesce(o.segment, c.segment) AS segment, coalesce(o.custkey, c.custkey) AS custkey, coalesce(o.status, c.status) AS status
FROM o FULL JOIN c ON o.custkey = c.custkey AND o.segment IS NOT DISTINCT FROM c.segment AND o.status IS NOT DISTINCT FROM c.status
"""


def common_order_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two projections of all orders; matches grow with a customer's orders of one status, not with the table."""
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = (
        F.col("o_custkey").alias("custkey"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"),
    )
    left = o.select(*keys, F.col("o_totalprice").alias("price"))
    right = o.select(F.col("o_orderdate").alias("ordered"), *keys[::-1])
    return sales.merge_common_columns(left, right)


COMMON_ORDER_ROWS = """
WITH o AS (SELECT o_custkey AS custkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(o_orderstatus, 'O') AS status
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT coalesce(l.custkey, r.custkey) AS custkey, coalesce(l.segment, r.segment) AS segment, coalesce(l.status, r.status) AS status
FROM o l FULL JOIN o r ON l.custkey = r.custkey AND l.segment IS NOT DISTINCT FROM r.segment AND l.status IS NOT DISTINCT FROM r.status
"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a dose in the name; brands in capitals before two blanks."""
    p = _t(spark, d, "part")
    return p.select(
        "p_partkey", "p_size", "p_brand", (F.col("p_size") % 3).cast("int").alias("part"),
        F.when(F.col("p_size") % 11 != 0, F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.lit(" [iU]")))
        .otherwise(F.col("p_name")).alias("generic_name"),
        F.when(F.col("p_size") % 4 != 0, F.concat(F.upper("p_name"), F.lit("   "), F.col("p_size")))
        .otherwise(F.lower("p_name")).alias("brand_latin_name"),
    )


_NAMED = """
n AS (SELECT p_partkey, p_size, p_brand, (p_size % 3)::INT AS part,
        CASE WHEN p_size % 11 <> 0 THEN p_name || ' ' || p_size || ' [iU]' ELSE p_name END AS generic_name,
        CASE WHEN p_size % 4 <> 0 THEN upper(p_name) || '   ' || p_size ELSE lower(p_name) END AS brand_latin_name FROM part)
"""


def brand_sales(spark: SparkSession, d: str) -> DataFrame:
    """Lines are summed by part first; names depend on the part alone."""
    rows = _sold_parts(spark, d).join(_named(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    out = sales.brand_totals(
        rows, "brand_latin_name", ["generic_name", "p_brand"], ["sale_count", "sale_amount"], ["place", "p_partkey"]
    )
    return out.select(
        "brand_latin_name", text.brand_prefix(F.col("brand_latin_name")).alias("prefix"), "generic_name", "p_brand",
        "sale_count", F.col("sale_amount").cast("double").alias("sale_amount"),
        text.first_integer(F.col("generic_name")).alias("dosage"),
    )


BRAND_SALES = f"""
WITH {_NAMED}
SELECT brand_latin_name, nullif(trim(regexp_extract(brand_latin_name, '^([A-Z\\s]+?)\\s{{2,}}', 1)), '') AS prefix,
       arg_min(generic_name, (l_orderkey, l_linenumber, p_partkey)) AS generic_name, arg_min(p_brand, (l_orderkey, l_linenumber, p_partkey)) AS p_brand,
       sum(l_quantity::BIGINT)::BIGINT AS sale_count, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sale_amount,
       nullif(regexp_extract(arg_min(generic_name, (l_orderkey, l_linenumber, p_partkey)), '([0-9]+)', 1), '')::BIGINT AS dosage
FROM lineitem JOIN n ON l_partkey = p_partkey GROUP BY brand_latin_name
"""


def _sold_2023(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of the 2023 file, with names of several factors."""
    kinds = F.array(*[F.lit(k) for k in ("Factor VIII ", "factor viii+VWF ", "Factor IX ", "FACTOR XI ", "Albumin ")])
    part = _t(spark, d, "part").select(
        "p_partkey", F.concat(F.get(kinds, F.col("p_size") % 5), F.col("p_size"), F.lit(" IU")).alias("generic_name"),
        F.concat(F.upper("p_name"), F.lit("  "), F.col("p_size")).alias("brand_latin_name"), F.col("p_type").alias("index_latin_name"),
        F.col("p_size").cast("string").alias("generic_code"), F.col("p_brand").alias("irc_code"),
    )
    return part.join(_sold_parts(spark, d), F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey", "place")


_SOLD_2023 = """
s AS (SELECT l_partkey, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q, sum(l_extendedprice::DECIMAL(18,2)) AS a FROM lineitem GROUP BY 1),
f AS (SELECT p_partkey, ['Factor VIII ', 'factor viii+VWF ', 'Factor IX ', 'FACTOR XI ', 'Albumin '][p_size % 5 + 1] || p_size || ' IU' AS generic_name,
             upper(p_name) || '  ' || p_size AS brand_latin_name, p_type AS index_latin_name, p_size::VARCHAR AS generic_code, p_brand AS irc_code, n, q, a
      FROM part JOIN s ON p_partkey = l_partkey)
"""


def names_2023(spark: SparkSession, d: str) -> DataFrame:
    return flows.tables_2023(_sold_2023(spark, d), ["p_partkey"])["dataset"]


NAMES_2023 = f"""
WITH {_SOLD_2023} SELECT index_latin_name, brand_latin_name, generic_name, generic_code, irc_code FROM f
WHERE contains(lower(generic_name), 'factor') AND NOT contains(lower(generic_name), 'ix') AND NOT contains(lower(generic_name), 'viia')
  AND NOT contains(lower(generic_name), 'xiii') QUALIFY row_number() OVER (PARTITION BY brand_latin_name ORDER BY p_partkey) = 1
"""


def prices_2023(spark: SparkSession, d: str) -> DataFrame:
    """The 2023 flow: factor VIII rows, sums by brand, the brand's capitals and the dosage."""
    return _doubles(flows.tables_2023(_sold_2023(spark, d), ["p_partkey"], strict=True)["prices"], "sale_amount")


PRICES_2023 = f"""
WITH {_SOLD_2023} SELECT nullif(trim(regexp_extract(brand_latin_name, '^([A-Z\\s]+?)\\s{{2,}}', 1)), '') AS brand_latin_name,
       arg_min(generic_name, p_partkey) AS generic_name, sum(n)::BIGINT AS count_of_package_sold, sum(q)::BIGINT AS sale_count, sum(a)::DOUBLE AS sale_amount,
       regexp_extract(arg_min(generic_name, p_partkey), '([0-9]+)', 1)::BIGINT AS dosage
FROM f WHERE contains(lower(generic_name), 'factor viii') GROUP BY f.brand_latin_name
"""


def part_profile(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d).withColumn("code", F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return sales.part_profile(named, "part", "code", ["generic_name", "code", "p_brand"])


PART_PROFILE = f"""
WITH {_NAMED}, c AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size END AS code FROM n)
SELECT part, count(code) AS n_code, count(DISTINCT generic_name) + max((generic_name IS NULL)::BIGINT) AS different_generic_name,
       count(DISTINCT code) + max((code IS NULL)::BIGINT) AS different_code,
       count(DISTINCT p_brand) + max((p_brand IS NULL)::BIGINT) AS different_p_brand, count(*) AS n_rows
FROM c GROUP BY part
"""


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("units"))
    return line.join(_named(spark, d).filter("part <> 2"), F.col("l_partkey") == F.col("p_partkey"))


def unit_consumption(spark: SparkSession, d: str) -> DataFrame:
    return sales.unit_consumption(_shipped(spark, d), "part", "generic_name", "units")


def unit_consumption_whole_part(spark: SparkSession, d: str) -> DataFrame:
    return sales.unit_consumption(_shipped(spark, d), "part", "generic_name", "units", whole_part=True)


UNIT_CONSUMPTION = f"""
WITH {_NAMED}
SELECT part, generic_name, sum(regexp_extract(generic_name, '([0-9]+)\\s*\\[iU\\]', 1)::BIGINT * l_quantity::BIGINT)::BIGINT AS total_iu
FROM lineitem JOIN n ON l_partkey = p_partkey WHERE part <> 2 AND generic_name LIKE '%[iU]' GROUP BY part, generic_name
"""
UNIT_CONSUMPTION_WHOLE_PART = f"""
WITH {_NAMED}, s AS (SELECT part, generic_name, l_quantity::BIGINT AS units FROM lineitem JOIN n ON l_partkey = p_partkey WHERE part <> 2),
t AS (SELECT part, sum(units) AS units FROM s GROUP BY part)
SELECT part, generic_name, (regexp_extract(generic_name, '([0-9]+)\\s*\\[iU\\]', 1)::BIGINT * units)::BIGINT AS total_iu
FROM (SELECT DISTINCT part, generic_name FROM s WHERE generic_name LIKE '%[iU]') JOIN t USING (part)
"""


def first_per_brand(spark: SparkSession, d: str) -> DataFrame:
    return sales.first_rows(_t(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_brand", ["p_partkey"])


FIRST_PER_BRAND = "SELECT p_partkey, p_name, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1"


def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_name").na.drop().distinct().orderBy("p_name")


DISTINCT_NAMES = "SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL ORDER BY p_name"


def parsed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Percent texts, thousands and strict prices made from numbers and parsed back."""
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    made = line.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 3, F.concat(F.round(F.col("l_discount") * 100).cast("int"), F.lit(" %"))).otherwise("unknown").alias("pct"),
        F.format_number(F.col("l_orderkey") * 1000 + F.col("l_linenumber"), 0).alias("count_text"),
        F.when(F.col("l_linenumber") != 2, F.concat(F.format_number(F.col("l_quantity") * 25000, 0), F.lit("-"))).otherwise("").alias("price"),
    )
    return filters.priced(made).select(
        "l_orderkey", "l_linenumber", text.share(F.col("pct")).alias("share"), text.thousands(F.col("count_text")).alias("count"), "price"
    )


PARSED_TEXTS = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN round(l_discount * 100)::INT / 100.0::DOUBLE END AS share,
       l_orderkey * 1000 + l_linenumber AS count, l_quantity * 25000 AS price
FROM lineitem WHERE l_linenumber <> 2 AND l_quantity * 25000 > 200000
"""


def known_only(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("Age not known"))
    return filters.fully_known(rows).drop("Age not known")


KNOWN_ONLY = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0.0"


def _pyramid(spark: SparkSession, d: str) -> DataFrame:
    age = F.col("o_custkey") % 102
    rows = _t(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.when(age == 100, F.lit("100+")).when(age == 101, F.lit("total")).otherwise(age.cast("string")).alias("Age"),
        F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 1000).cast("string")).alias("M"), F.lit("1").alias("F"),
    )
    return pyramid.with_prevalence(pyramid.clean_ages(rows), "M", "scaled", 17.1 / 100_000)


def pyramid_rows(spark: SparkSession, d: str) -> DataFrame:
    return _pyramid(spark, d).groupBy("year", "Age").agg(F.sum("M").alias("m"), F.round(F.sum("scaled"), 6).alias("scaled"))


def pyramid_totals(spark: SparkSession, d: str) -> DataFrame:
    return pyramid.yearly_totals(_pyramid(spark, d), "scaled").withColumn("total", F.round("total", 4)).orderBy("year")


_PYRAMID = """
p AS (SELECT year(o_orderdate)::INT AS year, CASE WHEN o_custkey % 102 = 100 THEN 100 ELSE (o_custkey % 102)::INT END AS "Age", (o_orderkey % 1000)::INT AS m
      FROM orders WHERE o_orderkey % 9 <> 0 AND o_custkey % 102 <> 101)
"""
PYRAMID_ROWS = f'WITH {_PYRAMID} SELECT year, "Age", sum(m)::BIGINT AS m, round(sum(m * (17.1::DOUBLE / 100000)), 6) AS scaled FROM p GROUP BY ALL'
PYRAMID_TOTALS = f"""
WITH {_PYRAMID} SELECT year, max("Age") AS max_age, max(m) AS max_m, round(sum(m * (17.1::DOUBLE / 100000)), 4) AS total FROM p GROUP BY ROLLUP (year)
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (widget_sales, WIDGET_SALES), (recombinant_split, RECOMBINANT_SPLIT), (merged_sales, MERGED_SALES), (other_factor_names, OTHER_FACTOR_NAMES),
        (common_rows, COMMON_ROWS), (common_order_rows, COMMON_ORDER_ROWS), (brand_sales, BRAND_SALES), (names_2023, NAMES_2023), (prices_2023, PRICES_2023), (part_profile, PART_PROFILE),
        (unit_consumption, UNIT_CONSUMPTION), (unit_consumption_whole_part, UNIT_CONSUMPTION_WHOLE_PART),
        (first_per_brand, FIRST_PER_BRAND), (distinct_names, DISTINCT_NAMES), (parsed_texts, PARSED_TEXTS),
        (known_only, KNOWN_ONLY), (pyramid_rows, PYRAMID_ROWS), (pyramid_totals, PYRAMID_TOTALS),
    )
}
