"""Numbers that look random but follow from a row's own number, so that every run and engine draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
#: Multipliers of the mixing steps, and of the salt before them; all below 2**31.
FACTORS, SALT = (1_540_483_477, 1_103_515_245, 747_796_405), 179_424_673
SHIFTS = (0, 13, 16)
#: A weight is k or more if a number reaches the k-th of these: the distribution function of Poisson(1) below k.
POISSON_CUTS = [
    round(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k))) for k in range(1, 12)
]


def with_hashed(df: DataFrame, number: str, salt: str, out: str = "hashed") -> DataFrame:
    """``df`` with a number in 0 .. PRIME - 1 from a number of 0 or above and a salt from 0 to 2**31; nothing exceeds
    2**63. Each step is a column of its own, so it is computed once."""
    df = df.withColumn("_salt", (F.col(salt).cast("long") + 1) * SALT % PRIME).withColumn(out, F.col(number).cast("long") % PRIME)
    for factor, shift in zip(FACTORS, SHIFTS, strict=True):
        x = F.col(out).bitwiseXOR(F.shiftright(out, shift)) if shift else F.col(out)
        df = df.withColumn(out, (x * factor + F.col("_salt")) % PRIME)
    return df.drop("_salt")


def poisson(hashed: Column) -> Column:
    """A Poisson(1) weight from a hashed number."""
    out = F.when(hashed < POISSON_CUTS[0], 0)
    for k, cut in enumerate(POISSON_CUTS[1:], 1):
        out = out.when(hashed < cut, k)
    return out.otherwise(len(POISSON_CUTS))


def hashed_sql(number: str, salt: str) -> str:
    """``with_hashed`` as SQL."""
    s = f"(({salt} + 1)::BIGINT * {SALT} % {PRIME})"
    t = f"(({number}) % {PRIME})"
    for factor, shift in zip(FACTORS, SHIFTS, strict=True):
        x = f"list_transform([{t}], lambda t: xor(t, t >> {shift}))[1]" if shift else t
        t = f"(({x} * {factor} + {s}) % {PRIME})"
    return t


def poisson_sql(hashed: str) -> str:
    cuts = " ".join(f"WHEN {hashed} < {cut} THEN {k}" for k, cut in enumerate(POISSON_CUTS))
    return f"CASE {cuts} ELSE {len(POISSON_CUTS)} END"
