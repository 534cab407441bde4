"""Long transition tables (scenario, from_state, to_state, prob): grids, row repair and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.sources.dimensions import CHRONIC, INHIBITOR, MAJOR, MINOR, NO_BLEED, SEVERE, SURGERY


def dense_grid(long: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of a scenario's states, with 0 where the table has no cell.

    ``states`` has the keys, ord and state; a stage has few states, so the grid is small for each scenario.
    """
    a = states.select(*keys, F.col("state").alias("from_state"), F.col("ord").alias("from_ord"))
    b = states.select(*keys, F.col("state").alias("to_state"), F.col("ord").alias("to_ord"))
    grid = a.join(b, keys)
    cells = long.groupBy(*keys, "from_state", "to_state").agg(F.sum("prob").alias("prob"))
    return grid.join(cells, [*keys, "from_state", "to_state"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def row_sums(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys, "from_state").agg(F.sum("prob").alias("row_sum"))


def repair_policy(spark: SparkSession) -> DataFrame:
    """(from_state, keep, gap): rows that keep a cell and rescale the others, and where a row's gap goes.

    Fixed values: bleeding rows and surgery keep the no-bleed cell; chronic, severe and inhibitor rows fill up
    themselves, all others minor bleeding.
    """
    keep = [(s, NO_BLEED, None) for s in (NO_BLEED, MINOR, MAJOR, SURGERY)]
    own = [(s, None, s) for s in (CHRONIC, SEVERE, INHIBITOR)]
    return spark.createDataFrame(keep + own, "from_state string, keep string, gap string")


def normalise_rows(
    grid: DataFrame, keys: list[str], policy: DataFrame, default_gap: str = MINOR, rest: tuple[str, str] = (CHRONIC, MINOR),
    tolerance: float = 1e-6,
) -> DataFrame:
    """Makes each row of a dense grid sum to 1.

    Rows within the tolerance stay. A row whose policy keeps a cell has its other cells scaled to what that cell leaves;
    if they are all 0, what is left goes to the first of ``rest`` that the scenario has. Else a sum above 1 divides the
    row, and a sum below 1 adds the gap to the policy's target, or to ``default_gap``. A target that isn't in the
    grid gets nothing.
    """
    row = Window.partitionBy(*keys, "from_state")
    p = policy.select(F.col("from_state").alias("_f"), "keep", "gap")
    df = grid.join(F.broadcast(p), F.col("from_state") == F.col("_f"), "left").drop("_f")
    kept = F.col("to_state").eqNullSafe(F.col("keep"))
    df = df.withColumns(
        {
            "_sum": F.sum("prob").over(row),
            "_kept": F.sum(F.when(kept, F.col("prob")).otherwise(0.0)).over(row),
            "_first": F.max(F.when(F.col("to_state") == rest[0], F.lit(1)).otherwise(0)).over(row),
        }
    ).withColumn("_others", F.sum(F.when(kept, 0.0).otherwise(F.col("prob"))).over(row))
    fallback = F.when(F.col("_first") == 1, F.lit(rest[0])).otherwise(F.lit(rest[1]))
    keeping = (
        F.when(kept, F.col("prob"))
        .when(F.col("_others") > 0, F.col("prob") * (1 - F.col("_kept")) / F.col("_others"))
        .when(F.col("to_state") == fallback, 1 - F.col("_kept"))
        .otherwise(F.col("prob"))
    )
    target = F.coalesce("gap", F.lit(default_gap))
    filling = (
        F.when(F.col("_sum") > 1, F.col("prob") / F.col("_sum"))
        .when(F.col("to_state") == target, F.col("prob") + 1 - F.col("_sum"))
        .otherwise(F.col("prob"))
    )
    new = F.when(F.abs(F.col("_sum") - 1) <= tolerance, F.col("prob")).when(F.col("keep").isNotNull(), keeping).otherwise(filling)
    return df.withColumn("prob", new).drop("keep", "gap", "_sum", "_kept", "_first", "_others")


def matrix_violations(long: DataFrame, states: DataFrame, keys: list[str], tolerance: float = 1e-5) -> DataFrame:
    """keys, state and what is wrong with it: ``sum`` (row doesn't sum to 1), ``cells`` (not one cell for each state),
    ``unknown`` (not a state of the scenario), ``missing`` (a state without a row)."""
    n = states.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = long.groupBy(*keys, F.col("from_state").alias("state")).agg(
        F.sum("prob").alias("_s"), F.count_distinct("to_state").alias("_c"), F.count("*").alias("_all")
    )
    rows = rows.join(n, keys, "left")
    bad_sum = rows.filter(F.abs(F.col("_s") - 1) > tolerance).select(*keys, "state", F.lit("sum").alias("problem"))
    bad_cells = rows.filter((F.col("_c") != F.col("_n")) | (F.col("_all") != F.col("_n")) | F.col("_n").isNull())
    used = long.select(*keys, F.explode(F.array("from_state", "to_state")).alias("state")).distinct()
    unknown = used.join(states.select(*keys, "state"), [*keys, "state"], "left_anti")
    missing = states.select(*keys, "state").join(rows.select(*keys, "state"), [*keys, "state"], "left_anti")
    return (
        bad_sum.union(bad_cells.select(*keys, "state", F.lit("cells")))
        .union(unknown.select(*keys, "state", F.lit("unknown")))
        .union(missing.select(*keys, "state", F.lit("missing")))
    )


def start_violations(starts: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, ``start``: start states that aren't states of their scenario."""
    known = states.select(*keys, "state")
    return starts.select(*keys, "state").distinct().join(known, [*keys, "state"], "left_anti").select(*keys, "state", F.lit("start").alias("problem"))


def initial_violations(initial: DataFrame, states: DataFrame, keys: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Problems of initial probabilities (keys, state, prob): ``initial`` (a scenario's don't sum to 1; no state is named)
    and ``start`` (a state that isn't one of the scenario's)."""
    total = initial.groupBy(*keys).agg(F.sum("prob").alias("_total"))
    bad = total.filter(F.abs(F.col("_total") - 1) > tolerance)
    bad = bad.select(*keys, F.lit(None).cast("string").alias("state"), F.lit("initial").alias("problem"))
    return bad.union(start_violations(initial, states, keys))


def assert_valid(
    long: DataFrame, states: DataFrame, keys: list[str], starts: DataFrame | None = None, initial: DataFrame | None = None
) -> None:
    """Raises if anything is wrong with the table, the start states or the initial probabilities; a few problems are
    named."""
    found = matrix_violations(long, states, keys)
    if starts is not None:
        found = found.union(start_violations(starts, states, keys))
    if initial is not None:
        found = found.union(initial_violations(initial, states, keys))
    rows = found.limit(5).collect()
    if rows:
        raise ValueError(f"transition table: {[tuple(r) for r in rows]}")


def stored_or_new(stored: DataFrame | None, new: DataFrame, states: DataFrame, override: bool = False) -> DataFrame:
    """The stored long table if its states are just those of ``states``, else the new one."""
    if stored is None or override:
        return new
    have = stored.select(F.col("to_state").alias("state")).distinct()
    want = states.select("state").distinct()
    differ = have.join(want, "state", "left_anti").union(want.join(have, "state", "left_anti"))
    return stored if differ.isEmpty() else new
