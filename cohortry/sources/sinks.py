"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortry.operators.filters import factor_viii_condition
from cohortry.operators.flows import sales_tables
from cohortry.sources.folders import delete, new_path


def save(df: DataFrame, path: str, form: str = "parquet", override: bool = True, **options: str) -> None:
    """One table; without ``override`` an existing one stays."""
    df.write.format(form).options(**options).mode("overwrite" if override else "ignore").save(path)


def save_sales(sales_1400: DataFrame, sales_1399: DataFrame, path: str, override: bool = True) -> None:
    """The four result tables of the yearly sales flow under one folder."""
    for name, df in sales_tables(sales_1400, sales_1399).items():
        save(df, f"{path}/{name}", override=override)


def save_sales_once(sales_1400: DataFrame, sales_1399: DataFrame, path: str) -> dict[str, int]:
    """The four result tables of the yearly sales flow as one table with partitions ``dataset``; columns that a table
    doesn't have are null in its rows. Returns rows, factor rows and recombinant rows of each year.

    Each year is read once: its factor rows, a small part, are staged in the shared folder, and the counts are taken on
    the way; a task that runs again counts once. The four tables come from the staged rows and are written in one job.
    """
    spark = sales_1400.sparkSession
    staging, seen, kept = new_path(spark, "sales"), {}, []
    for year, df in (("1400", sales_1400), ("1399", sales_1399)):
        seen[year] = Observation(f"sales-{year}")
        factor = F.col("_factor")
        recombinant = factor & F.coalesce(F.contains(F.lower("generic_name"), F.lit("recombinant")), F.lit(False))
        counts = {"rows": F.lit(True), "factor_rows": factor, "recombinant_rows": recombinant}
        marked = df.withColumn("_factor", factor_viii_condition())
        marked = marked.observe(seen[year], *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])
        kept.append(marked.filter("_factor").drop("_factor").withColumn("_year", F.lit(year)))
    kept[0].unionByName(kept[1], allowMissingColumns=True).write.parquet(staging)
    rows = spark.read.parquet(staging)
    years = [rows.filter(F.col("_year") == year).select(*df.columns) for year, df in (("1400", sales_1400), ("1399", sales_1399))]
    out = None
    for name, df in sales_tables(*years).items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("dataset").parquet(path)
    delete(spark, staging)
    return {f"{n}_{year}": count for year, observed in seen.items() for n, count in observed.get.items()}


def wide_matrix(long: DataFrame, states: list[str]) -> DataFrame:
    """One row per scenario and from-state, a column for each state; cells that aren't there are 0."""
    return long.groupBy("scenario", "from_state").pivot("to_state", states).agg(F.first("prob")).na.fill(0.0, states)


def save_matrix(long: DataFrame, states: list[str], path: str) -> None:
    save(wide_matrix(long, states), path, "csv", header="true")


def save_records(df: DataFrame, fields: list[str], path: str) -> None:
    save(df.select(*fields), path, "csv", header="true")
