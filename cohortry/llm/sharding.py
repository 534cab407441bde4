"""Sharding by a Feistel permutation of global row numbers (built-in functions only).

Rows get dense numbers 0..n-1, a Feistel network permutes these numbers, and the permuted number gives shard and slot:
``shard = p mod shards``, ``slot = p div shards``. Counts of shards differ by one at most (law ``rows``).

Equal rows are interchangeable, so they are counted before anything is shuffled, and a count of more than ``COPIES`` is
dealt out in pieces: a document that makes up a third of the table is neither sorted nor written by one task. All hashes
are plain arithmetic on numbers below 2**31, which any engine with 64-bit integers repeats.

Edge cases: an empty table gives an empty table; null keys are numbered like other values; rows that are equal in all
keys are interchangeable and each gets its own slot; ``row_numbers`` replaces a column ``_row`` or ``_n`` and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import let, table

BUCKETS = 4096
#: Equal rows that are numbered together at most.
COPIES = 65_536
ROUNDS = 6
WALKS = 64
PRIME = (1 << 31) - 1
#: Multipliers of the round function, below 2**31.
FACTORS = (1_540_483_477, 1_103_515_245, 747_796_405)


def mixed(x: Column, salt: Column) -> Column:
    """A number in 0 .. PRIME - 1 from numbers of 0 or above and a salt below 2**31; nothing exceeds 2**62."""
    first = (F.pmod(x, F.lit(PRIME)) * FACTORS[0] + salt) % PRIME
    second = let(first, lambda t: (t.bitwiseXOR(F.shiftright(t, 13)) * FACTORS[1] + salt) % PRIME)
    return let(second, lambda t: (t.bitwiseXOR(F.shiftright(t, 16)) * FACTORS[2] + salt) % PRIME)


def _offsets(df: DataFrame, bucket: Column, weight: Column) -> DataFrame:
    """_bucket, _offset, _n: rows before each bucket and in all; one row per bucket, numbered in one task."""
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.sum(weight).alias("_in_bucket"))
    whole = Window.partitionBy(F.lit(0))
    return counts.select(
        "_bucket",
        (F.sum("_in_bucket").over(whole.orderBy("_bucket")) - F.col("_in_bucket")).alias("_offset"),
        F.sum("_in_bucket").over(whole).alias("_n"),
    )


def row_numbers(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``_row`` (0..n-1, dense, the same for any partitioning of the input) and ``_n``.

    Rows are dealt to a fixed number of hash buckets and numbered inside each, so no task orders the whole table; the
    buckets' offsets are one row per bucket. All keys decide the bucket, so only rows equal in all of them must meet.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("_row", "_n")]).alias("row"))
    order = [F.col(f"row.`{k}`") for k in keys]
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = rows.withColumn("_bucket", bucket).withColumn("_at", at)
    offsets = F.broadcast(_offsets(rows, bucket, F.lit(1)))  # at most `buckets` rows
    return numbered.join(offsets, "_bucket").select("row.*", "_n", (F.col("_offset") + F.col("_at") - 1).alias("_row"))


def numbered_copies(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The keys of each row of ``df``, with ``_row`` and ``_n`` as ``row_numbers`` has them; keys are numbers of 0 or
    above, or null. Equal rows are counted first."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_copies"))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES).cast("long"))).alias("_piece")
    dealt = counted.select(*keys, "_copies", pieces)
    here = F.least(F.lit(COPIES).cast("long"), F.col("_copies") - F.col("_piece") * COPIES)
    bucket = mixed(F.col("_piece"), F.lit(0))
    for k in keys:
        bucket = mixed(bucket + F.coalesce(F.pmod(F.col(k).cast("long"), F.lit(PRIME)), F.lit(PRIME)), F.lit(1))
    dealt = dealt.select(*keys, "_piece", here.alias("_here"), (bucket % buckets).cast("int").alias("_bucket"))
    line = Window.partitionBy("_bucket").orderBy(*keys, "_piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_at", F.sum("_here").over(line) - F.col("_here"))
    offsets = F.broadcast(_offsets(dealt, F.col("_bucket"), F.col("_here")))  # at most `buckets` rows
    first = F.col("_offset") + F.col("_at")
    rows = F.explode(F.sequence(first, first + F.col("_here") - 1)).alias("_row")
    return placed.join(offsets, "_bucket").select(*keys, "_n", rows)


def feistel(number: Column, n: Column, seed: int) -> Column:
    """A permutation of 0..n-1: an unbalanced Feistel network over a*b >= n cells, left by cycle walking.

    a = ceil(sqrt(n)), b = ceil(n / a), so fewer than a cells lie outside. A walk meets no cell twice: for n up to 4,096
    it ends after 64 steps at the latest, and beyond that a walk of 64 steps has a chance below 64^-63; it would raise
    an error.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    b = F.greatest(F.ceil(n / a).cast("long"), F.lit(1))

    def turn(x: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left, right, salt = s["l"], s["r"], i + F.lit(ROUNDS * seed)
            return F.when(i % 2 == 0, F.struct(((left + mixed(right, salt)) % a).alias("l"), right.alias("r"))).otherwise(
                F.struct(left.alias("l"), ((right + mixed(left, salt)) % b).alias("r"))
            )

        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), turn(number), lambda x, _: F.when(x < n, x).otherwise(turn(x))
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def document_shards(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes: size 16 and checksum 0; of a text of any length only size and checksum are kept. ``grown_shard`` is null, as law ``rows`` deals anew when the
    number of shards changes.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = numbered_copies(rows, ["doc_id", "text_crc32", "size"])
    placed = placed.withColumn("_place", feistel(F.col("_row"), F.col("_n"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(table(spark, sf_dir, "documents"))


def _mixed_sql(x: str, salt: str) -> str:
    t = f"((({x}) % {PRIME}) * {FACTORS[0]} + {salt}) % {PRIME}"
    for factor, shift in ((FACTORS[1], 13), (FACTORS[2], 16)):
        t = f"list_transform([({t})], lambda t: (xor(t, t >> {shift}) * {factor} + {salt}) % {PRIME})[1]"
    return t


def _bucket_sql() -> str:
    t = _mixed_sql("piece", "0")
    for k in ("doc_id", "text_crc32", "size"):
        t = _mixed_sql(f"({t}) + coalesce((({k} % {PRIME}) + {PRIME}) % {PRIME}, {PRIME})", "1")
    return t


_STEP = f"""CASE WHEN e.i % 2 = 0
    THEN {{'l': (s.l + {_mixed_sql("s.r", "e.i + {seed}")}) % s.a, 'r': s.r, 'i': 0::BIGINT, 'a': s.a, 'b': s.b}}
    ELSE {{'l': s.l, 'r': (s.r + {_mixed_sql("s.l", "e.i + {seed}")}) % s.b, 'i': 0::BIGINT, 'a': s.a, 'b': s.b}} END""".replace("{seed}", str(ROUNDS * 7))
_ROUNDS = ", ".join(f"{{'l': 0::BIGINT, 'r': 0::BIGINT, 'i': {i}::BIGINT, 'a': 1::BIGINT, 'b': 1::BIGINT}}" for i in range(ROUNDS))


def _turn_sql(x: str) -> str:
    start = f"{{'l': ({x}) // b, 'r': ({x}) % b, 'i': 0::BIGINT, 'a': a, 'b': b}}"
    return f"list_reduce([{start}, {_ROUNDS}], lambda s, e: {_STEP})"


#: Bytes whose checksum is taken at a time.
_PIECE = 2048
_XOR = "list_reduce([CASE WHEN ({x} >> i) & 1 = 1 THEN {images}[i + 1] ELSE 0 END FOR i IN range(32)], lambda e, f: xor(e, f))"
#: The checksum is taken byte by byte in pieces, over the table of 256 remainders. It is linear: a piece counts with its
#: remainder moved over the pieces after it, so ``moved`` has what each bit becomes j pieces later. A walk ends at the
#: first number below n.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c, i FROM range(256) AS t(i)),
remainders AS (SELECT list(c ORDER BY i) AS rem FROM bits),
hexes AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT r, doc_id, length(h) // 2 AS bytes, greatest(1, (length(h) // 2 + {_PIECE} - 1) // {_PIECE}) AS m, h FROM hexes),
pieces AS (SELECT r, m - 1 - k AS j, k, CASE WHEN k = 0 THEN substr(h, 1, 2 * first) ELSE substr(h, 2 * (first + (k - 1) * {_PIECE}) + 1, {2 * _PIECE}) END AS h
           FROM (SELECT r, m, h, bytes - (m - 1) * {_PIECE} AS first, unnest(range(0, m)) AS k FROM sized)),
states AS (SELECT r, j, list_reduce(list_prepend(CASE WHEN k = 0 THEN 4294967295 ELSE 0 END::BIGINT, [('0x' || h[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, length(h) // 2 + 1)]),
                  lambda c, x: xor(c >> 8, rem[(xor(c, x) & 255) + 1])) AS c FROM pieces, remainders),
one AS (SELECT list(c ORDER BY b) AS one FROM (SELECT b, list_reduce(list_prepend(1::BIGINT << b::INT, list_transform(range({_PIECE}), lambda z: 0::BIGINT)),
                  lambda c, z: xor(c >> 8, rem[(c & 255) + 1])) AS c FROM range(32) AS t(b), remainders)),
moved AS (SELECT 0::BIGINT AS j, [1::BIGINT << b::INT FOR b IN range(32)] AS p
          UNION ALL SELECT j + 1, [{_XOR.format(x="x", images="one")} FOR x IN p] FROM moved, one WHERE j < (SELECT max(m) FROM sized)),
crcs AS (SELECT r, xor(4294967295, bit_xor({_XOR.format(x="c", images="p")})) AS text_crc32 FROM states JOIN moved USING (j) GROUP BY r),
d AS (SELECT doc_id, bytes + 16 AS size, text_crc32 FROM sized JOIN crcs USING (r)),
c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, text_crc32, size) - 1) // {COPIES} AS piece FROM d),
b AS (SELECT *, ({_bucket_sql()}) % {BUCKETS} AS bucket FROM c),
r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size, piece) - 1 AS number FROM b),
n AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM (SELECT count(*) AS n FROM d))),
w AS (SELECT doc_id, size, text_crc32, n, a, b, {_turn_sql("number")} AS v FROM r, n
      UNION ALL SELECT doc_id, size, text_crc32, n, a, b, {_turn_sql("v.l * b + v.r")} FROM w WHERE v.l * b + v.r >= n),
p AS (SELECT doc_id, size, text_crc32, v.l * b + v.r AS p FROM w WHERE v.l * b + v.r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 40)::INT AS shard, p // 40 AS slot, NULL::INT AS grown_shard FROM p
"""
