"""Variance-based sensitivity indices from paired model evaluations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.weights import poisson, with_hashed

#: Half the width of a 0.95 interval in standard deviations.
Z_95 = 1.959963984540054


def sobol_of_rows(df: DataFrame, a: str, b: str, mixed: Sequence[str]) -> DataFrame:
    """(input, s1, st) from one row per base: evaluations of both blocks, and of A with one column of B each.

    With y standardised over all evaluations and var the variance of A and B together, s1 = mean(B (AB_i - A)) / var and
    st = mean((A - AB_i)^2) / 2 / var. The deviation cancels, so one aggregate of plain sums gives all of it. Rows that
    lack an evaluation count for the mean only.
    """
    names = [a, b, *mixed]
    cells: list[Column] = [F.col(c) for c in names]
    whole = reduce(lambda x, y: x & y, [c.isNotNull() for c in cells])

    def total(x: Column) -> Column:
        return F.sum(F.when(whole, x))

    x, y = F.col(a), F.col(b)
    parts = [
        F.try_divide(
            reduce(lambda p, q: p + q, [F.coalesce(F.sum(c), F.lit(0.0)) for c in cells]), reduce(lambda p, q: p + q, [F.count(c) for c in cells])
        ).alias("_m"),
        F.count(F.when(whole, 1)).alias("_n"), total(x + y).alias("_s"), total(x * x + y * y).alias("_q"),
    ]
    for i, c in enumerate(mixed):
        d = F.col(c) - x
        parts += [total(y * d).alias(f"_p{i}"), total(d).alias(f"_d{i}"), total(d * d).alias(f"_e{i}")]
    sums = df.agg(*parts)
    mean = F.col("_s") / (2 * F.col("_n"))
    var = F.col("_q") / (2 * F.col("_n")) - mean * mean
    rows = [
        F.struct(
            F.lit(i + 1).alias("input"), F.try_divide((F.col(f"_p{i}") - F.col("_m") * F.col(f"_d{i}")) / F.col("_n"), var).alias("s1"),
            F.try_divide(F.col(f"_e{i}") / (2 * F.col("_n")), var).alias("st"),
        )
        for i in range(len(mixed))
    ]
    return sums.filter("_n > 0").select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sobol_indices(evaluations: DataFrame, inputs: int) -> DataFrame:
    """``sobol_of_rows`` from the long form (base_id, block, y), blocks A, B, AB_1 ... AB_k."""
    blocks = ["A", "B", *[f"AB_{i}" for i in range(1, inputs + 1)]]
    wide = evaluations.groupBy("base_id").pivot("block", blocks).agg(F.first("y"))
    return sobol_of_rows(wide, "A", "B", blocks[2:])


def sobol_with_confidence(
    df: DataFrame, key: str, a: str, b: str, mixed: Sequence[str], swapped: Sequence[str], replicates: int = 100, z: float = Z_95
) -> DataFrame:
    """(kind, input, other, value, conf) from one row per base: evaluations of both blocks, of A with one column of B
    each (``mixed``), and of B with one column of A each (``swapped``).

    ``kind`` is s1, st or s2 (of two inputs, ``input`` < ``other``); s2 = mean(BA_j AB_k - A B) / var - s1_j - s1_k with
    centred y. ``conf`` is ``z`` standard deviations of the values that ``replicates`` resamples of the rows give. A
    resample gives each row a Poisson(1) weight that follows from ``key`` (a number of 0 or above) and the replicate, so
    rows are resampled where they are: each is repeated for the replicates inside its task and summed there, one row per
    task and replicate is shuffled, and reruns agree. Rows that lack an evaluation are left out; without rows, or where
    nothing varies, there is no row or a null value.
    """
    k = len(mixed)
    x, y, w = F.col(a), F.col(b), F.col("_w")
    ab, ba = [F.col(c) for c in mixed], [F.col(c) for c in swapped]
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    rows = df.select(F.col(key).alias("_key"), a, b, *mixed, *swapped).na.drop()
    rows = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    rows = with_hashed(rows, "_key", "_r", "_h")
    rows = rows.withColumn("_w", F.when(F.col("_r") == 0, 1).otherwise(poisson(F.col("_h"))).cast("double"))
    terms = {"n": F.lit(1.0), "x": x, "y": y, "q": x * x + y * y, "xy": x * y}
    for i in range(k):
        d = ab[i] - x
        terms |= {f"ab{i}": ab[i], f"ba{i}": ba[i], f"p{i}": y * d, f"d{i}": d, f"e{i}": d * d}
    terms |= {f"v{i}_{j}": ba[i] * ab[j] for i, j in pairs}
    sums = rows.groupBy("_r").agg(*[F.sum(w * c).alias(n) for n, c in terms.items()])
    every = ["x", "y", *[f"{c}{i}" for i in range(k) for c in ("ab", "ba")]]
    whole = sums.filter("_r = 0").select((reduce(lambda p, q: p + q, [F.col(c) for c in every]) / (len(every) * F.col("n"))).alias("m"))
    n, m = F.col("n"), F.col("m")
    mean = (F.col("x") + F.col("y")) / (2 * n)
    parts = sums.crossJoin(F.broadcast(whole)).withColumn("var", F.col("q") / (2 * n) - mean * mean)  # one row
    parts = parts.withColumns({f"s1_{i}": F.try_divide((F.col(f"p{i}") - m * F.col(f"d{i}")) / n, F.col("var")) for i in range(k)})

    def row(kind: str, i: int, j: int | None, value: Column) -> Column:
        other = F.lit(None if j is None else j + 1).cast("int")
        return F.struct(F.lit(kind).alias("kind"), F.lit(i + 1).alias("input"), other.alias("other"), value.alias("value"))

    found = [row("s1", i, None, F.col(f"s1_{i}")) for i in range(k)]
    found += [row("st", i, None, F.try_divide(F.col(f"e{i}") / (2 * n), F.col("var"))) for i in range(k)]
    for i, j in pairs:
        both = F.col(f"v{i}_{j}") - F.col("xy") - m * (F.col(f"ba{i}") + F.col(f"ab{j}") - F.col("x") - F.col("y"))
        found.append(row("s2", i, j, F.try_divide(both / n, F.col("var")) - F.col(f"s1_{i}") - F.col(f"s1_{j}")))
    cells = parts.select("_r", F.explode(F.array(*found)).alias("c")).select("_r", "c.*")
    return cells.groupBy("kind", "input", "other").agg(
        F.max(F.when(F.col("_r") == 0, F.col("value"))).alias("value"),
        (F.stddev_samp(F.when(F.col("_r") > 0, F.col("value"))) * z).alias("conf"),
    )
