"""Benchmark decontamination by a prefix-filtered join (built-in functions only).

Benchmark windows are sequences of 13 words (or a whole shorter item), seen as sets of placed shingles of five words.
Shingles are ordered by rarity: by how many places of the benchmark they have, then by hash. Containment is complete, so
the prefix that every match must share is a window's rarest shingle alone, and only these prefixes are looked up: a text
is read once and each of its places is hashed with its next words. Where a place has a window's prefix, the prefix's
place in the window gives the window's start, bounds on start and length are applied, and the words there are compared
by hash; what is left carries its words and is compared with the window word by word.

Windows are looked up in parts of ``PART`` prefixes, each broadcast for one pass over the texts; a benchmark of more
windows costs more passes, in the same way. No text or array of words is shuffled.

Edge cases: a text of any length is read whole; a null text or one without words has no hits; a null or wordless item has no windows; an empty benchmark
leaves every document clean; an item that occurs twice with the same id counts once; each row of a repeated document is
reported; a null item_id isn't listed. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import plain_words, table, written

WINDOW = 13
SHINGLE = 5
#: Windows that are broadcast for one pass over the texts; five numbers each.
PART = 1_000_000
#: Key of the one entry that every document finds in the first pass, so that it is reported without hits too.
PRESENT = 0


def _key(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from place ``at`` (from 0)."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + j) for j in range(size)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """win, its words w, their number, the size of its shingles and the ids of its items, one row per different window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = items.filter(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("s")).select(
        "item_id", F.concat_ws(" ", F.slice("words", F.col("s") + 1, window)).alias("win")
    )
    w = F.split("win", " ")
    return cut.groupBy("win").agg(F.collect_set("item_id").alias("items")).select(
        "win", w.alias("w"), F.size(w).alias("length"), F.least(F.lit(shingle), F.size(w)).alias("size"), "items"
    )


def _covered(spans: Column) -> Column:
    """Places inside any of the spans (start, stop)."""
    none = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def add(done: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], done["stop"]))
        return F.struct(F.greatest(done["stop"], x["stop"]).alias("stop"), (done["n"] + new).alias("n"))

    return F.aggregate(F.sort_array(spans), none, add, lambda done: done["n"]).cast("long")


def window_prefixes(windows: DataFrame) -> DataFrame:
    """key, at, size, length, whole for each window: hash and place of its rarest shingle, and the hash of its words."""
    places = F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size")))
    pieces = windows.select("win", "w", "length", "size", places.alias("at"))
    pieces = pieces.withColumn("piece", F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("size"))))
    counts = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    order = F.struct("n", F.xxhash64("piece").alias("h"), "piece", "at")
    rarest = pieces.join(counts, "piece").groupBy("win", "length", "size").agg(F.min(order).alias("rarest"))
    words = F.split("rarest.piece", " ")
    return rarest.select(
        F.xxhash64("size", *[F.get(words, F.lit(j)) for j in range(SHINGLE)]).alias("key"), F.col("rarest.at").alias("at"),
        "size", "length", F.xxhash64("win").alias("whole"),
    )


def prefix_hits(docs: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows that stand in a text by their hashes: doc_id, print (of the text), n_words, start, stop and the words
    there; and a row without start for each entry of length 0 (``PRESENT``). ``prefixes`` is broadcast."""
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("print"),
        plain_words(F.col("text")).alias("words"),
    )
    places = text.select("doc_id", "print", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("pos"))
    sizes = sizes or [SHINGLE]
    own = F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*[F.lit(k) for k in sizes]))
    places = places.withColumn("own", own)
    key = F.when((F.col("pos") < 0) & (F.col("own") == sizes[0]), F.lit(PRESENT).cast("long"))
    for k in sizes:
        key = key.when((F.col("pos") >= 0) & (F.col("own") == k), _key(F.col("words"), F.col("pos"), k))
    n, start, length = F.size("words"), F.col("pos") - F.col("at"), F.col("length")
    stands = (F.col("size") == F.col("own")) & (start >= 0) & (start + length <= n)
    there = F.concat_ws(" ", F.slice("words", start + 1, length))
    fits = F.when(F.col("pos") < 0, length == 0).otherwise((length > 0) & stands & (F.xxhash64(there) == F.col("whole")))
    found = places.withColumn("own_key", key).join(F.broadcast(prefixes), (F.col("own_key") == F.col("key")) & fits)
    real = F.col("pos") >= 0
    return found.select(
        "doc_id", "print", n.cast("long").alias("n_words"), F.when(real, start).alias("start"),
        F.when(real, start + length).alias("stop"), F.when(real, there).alias("win"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    return row_contamination(docs, benchmark, window, shingle).drop("print")


def row_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, part: int = PART
) -> DataFrame:
    """``contamination`` with ``print``, the hash of a row's text: rows of one doc_id, or of none, are told apart."""
    windows = written(benchmark_windows(benchmark, window, shingle), "bench-windows")
    prefixes = written(window_prefixes(windows), "bench-prefixes")
    by_size = {r["size"]: r["n"] for r in prefixes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # five at most
    sizes, parts = sorted(by_size), max(1, -(-sum(by_size.values()) // part))
    present = docs.sparkSession.range(1).select(
        F.lit(PRESENT).cast("long").alias("key"), *[F.lit(0).alias(c) for c in ("at", "size", "length")],
        F.lit(None).cast("long").alias("whole"),
    )
    # keys are hashes, so parts are of about equal size
    cuts = [prefixes.filter(F.pmod("key", F.lit(parts)) == k) for k in range(parts)]
    passes = [prefix_hits(docs, present.union(cuts[0]), sizes), *[prefix_hits(docs, c, sizes) for c in cuts[1:]]]
    hits = written(reduce(DataFrame.union, passes), "bench-hits")

    rows = hits.filter("start is null").select("doc_id", "print", "n_words")
    hit = hits.filter("start is not null").select("doc_id", "print", "start", "stop", "win").distinct()
    found = (
        hit.join(windows.select("win", "items"), "win").groupBy("doc_id", "print")
        .agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
        .select("doc_id", "print", _covered(F.col("spans")).alias("n_hit"), F.sort_array(F.array_distinct("items")).alias("items"))
    )
    same = [rows[c].eqNullSafe(found[c]) for c in ("doc_id", "print")]
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, same[0] & same[1], "left").select(
        rows["doc_id"], rows["print"], "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM win),
pos AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS t
        FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dw, ls WHERE len(w) >= l)),
m AS (SELECT doc_id, item_id, s, pos.l FROM pos JOIN win ON pos.t = win.t AND pos.l = win.l),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
