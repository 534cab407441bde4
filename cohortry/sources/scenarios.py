"""A stored table of transition matrices, one partition per scenario, of which only what is out of date is rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.matrix import assert_valid

STORED, STALE, MISSING = "stored", "stale", "missing"
CELLS = "from_state string, to_state string, prob double"


def scenario_status(stored: DataFrame | None, states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status for each scenario of ``states``: ``missing`` without stored rows, ``stale`` if the stored cells' states
    aren't just the wanted ones, else ``stored``. One pass over the stored table; a scenario has few states."""
    want = states.groupBy(*keys).agg(F.sort_array(F.collect_set("state")).alias("_want"))
    if stored is None:
        return want.select(*keys, F.lit(MISSING).alias("status"))
    have = stored.groupBy(*keys).agg(
        F.sort_array(F.collect_set("to_state")).alias("_to"), F.sort_array(F.collect_set("from_state")).alias("_from")
    )
    same = (F.col("_to") == F.col("_want")) & (F.col("_from") == F.col("_want"))
    status = F.when(F.col("_to").isNull(), MISSING).when(same, STORED).otherwise(STALE)
    return want.join(have, keys, "left").select(*keys, status.alias("status"))


def kept_or_new(stored: DataFrame | None, new: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cells and status: the stored cells of each scenario that is up to date, the new ones of the others.

    Both sides are cut by a join per scenario, so nothing is decided on the driver and each input is planned once;
    stored scenarios that ``states`` doesn't have are left out.
    """
    cells = [*keys, "from_state", "to_state", "prob"]
    status = scenario_status(stored, states, keys)
    anew = new.select(*cells).join(status.filter(F.col("status") != STORED), keys)
    if stored is None:
        return anew.select(*cells, "status")
    kept = stored.select(*cells).join(status.filter(F.col("status") == STORED), keys)
    return kept.select(*cells, "status").union(anew.select(*cells, "status"))


def stored_scenarios(spark: SparkSession, path: str, states: DataFrame, keys: list[str]) -> DataFrame | None:
    """The stored table, or None where nothing is stored; any path that Spark can open."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    kinds = ", ".join(f"{k} {states.schema[k].dataType.simpleString()}" for k in keys)
    return spark.read.schema(f"{CELLS}, {kinds}").parquet(path)


def refresh_scenarios(
    spark: SparkSession, path: str, new: DataFrame, states: DataFrame, keys: list[str], override: bool = False, checked: bool = True
) -> None:
    """Writes the scenarios that are missing or stale at ``path`` (all with ``override``); partitions of the others, and
    of scenarios that ``states`` doesn't have, stay as they are. What is written must be valid unless ``checked`` is off.

    Only partitions that get rows are overwritten, each as a whole, so a task that is run again, or a second refresh,
    leaves the same table.
    """
    stored = None if override else stored_scenarios(spark, path, states, keys)
    due = scenario_status(stored, states, keys).filter(F.col("status") != STORED).drop("status")
    rows = new.select(*keys, "from_state", "to_state", "prob").join(due, keys)
    if checked:
        assert_valid(rows, states.join(due, keys, "left_semi"), keys)
    writer = rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)
