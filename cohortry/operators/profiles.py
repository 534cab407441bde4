"""What the text columns of a table hold, and their casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.text import ascii_digits, number, share

SHARE, WHOLE, DECIMAL, TEXT = "share", "whole", "decimal", "text"
_COUNTS = ("values", "percents", "shares", "numbers", "wholes", "separated")


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string"]


def column_profile(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each text column: column, kind, and how many cells have a value, a percent sign, a number once percent
    signs and blanks, or thousands separators, are gone, a whole number, or a separator; from one pass over the table.

    ``kind``: ``share`` where any cell has a percent sign, ``text`` for the columns of ``keep`` and those without any
    number, else ``whole`` or ``decimal``. A kind says what a cast makes of the column; cells that don't fit become null
    by it, and the counts say how many these are.
    """
    def counts(c: str) -> Column:
        x = ascii_digits(F.col(f"`{c}`"))
        bare = F.replace(x, F.lit(","), F.lit(""))
        tests = (
            x.isNotNull(), F.contains(x, F.lit("%")), share(x).isNotNull(), number(x).isNotNull(),
            bare.try_cast("bigint").isNotNull() & ~F.contains(bare, F.lit(".")), F.contains(x, F.lit(",")),
        )
        return F.struct(F.lit(c).alias("column"), *[F.count(F.when(t, 1)).alias(n) for n, t in zip(_COUNTS, tests, strict=True)])

    names = text_columns(df)
    schema = ", ".join(["column string", *[f"{n} long" for n in _COUNTS]])
    if not names:
        return df.sparkSession.createDataFrame([], f"column string, kind string, {', '.join(f'{n} long' for n in _COUNTS)}")
    cells = df.agg(*[counts(c).alias(f"c{k}") for k, c in enumerate(names)])
    rows = cells.select(F.inline(F.array(*[F.col(f"c{k}").cast(f"struct<{schema.replace(' ', ':')}>".replace(",:", ",")) for k in range(len(names))])))
    kind = (
        F.when(F.col("percents") > 0, SHARE).when(F.col("column").isin(*keep) | (F.col("numbers") == 0), TEXT)
        .when(F.col("wholes") == F.col("numbers"), WHOLE).otherwise(DECIMAL)
    )
    return rows.select("column", kind.alias("kind"), *_COUNTS)


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns by their kinds: shares as fractions, numbers as BIGINT or DOUBLE; cells that are none become null."""
    casts = {
        SHARE: share, DECIMAL: number, WHOLE: lambda x: F.replace(ascii_digits(x), F.lit(","), F.lit("")).try_cast("bigint"),
    }
    return df.withColumns({c: casts[k](F.col(f"`{c}`")) for c, k in kinds.items() if k in casts})


def cast_by_content(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``df`` with its text columns cast to what they hold. The plan is made from one row for each column; ``df`` is
    read twice, so a costly one should be written first."""
    return cast_columns(df, {r["column"]: r["kind"] for r in column_profile(df, keep).collect()})
