"""Host-level quality rules (built-in functions only).

Each document is measured inside its own row and held against each rule of ``RULES``; the failures of each rule are
summed by host. A rule's rates over all hosts give it a beta prior of its own, fitted by moments, and a host's posterior
is that prior plus its own counts. A host breaks a rule if the lower credible bound of its rate lies above both
``LEAST_RATE`` and ``RATIO`` times the mean host's rate; a host that breaks any rule loses all its documents. So a host
is rejected for what it does much more often than others, once it has enough documents to be sure of it; a rule that
most hosts fail alike rejects none.

Edge cases: a null or blank text has no words and fails ``few_words``; a null host is a host of its own; an empty table
gives an empty table; a single host equals the mean and is never rejected; repeated rows count each; a text of any length
is measured whole, in its own row; only doc_id, text and the host column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import SPACED_WORD, let, table, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Other rules: symbols for each 100 words, repeated lines of 100, and the least and largest mean of a word's characters.
MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT, WORD_CHARS = 10, 30, (3, 12)
#: A host breaks a rule if the lower bound of its rate, so many standard deviations below its mean, is above both of these.
LEAST_RATE, RATIO, DEVIATIONS = 0.2, 2.0, 3.0
PRIOR_WEIGHTS = (1.0, 1e6)
#: Rule -> whether a document with these counts fails it.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words",
    "lines": f"100 * n_dup_lines > {MAX_LINE_PERCENT} * n_lines",
    "word_length": f"word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words",
}
BASE_RULES = ("few_words", "repeats")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array.

    Windows are told apart by 64-bit hashes, those of one text only; the two at the end that are shorter equal no other.
    Where none repeats that is all. Else hashes are sorted with their places, and windows beside one of the same hash are
    compared with it word by word.
    """

    def hashes(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(ws: Column, hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal(x: Column, y: Column) -> Column:
            """One hash, and the same three words; a neighbour that isn't there has none."""
            same = [F.get(ws, x["i"] + j) == F.get(ws, y["i"] + j) for j in range(3)]
            return F.coalesce((x["h"] == y["h"]) & same[0] & same[1] & same[2], F.lit(False))

        twice = let(placed, lambda s: F.filter(s, lambda x, k: equal(x, F.get(s, k - 1)) | equal(x, F.get(s, k + 1))))
        places = F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    def counted(ws: Column, hs: Column) -> Column:
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(ws, hs))

    return let(words, lambda ws: let(hashes(ws), lambda hs: counted(ws, hs)))


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the host, the counts, a 0/1 column for each rule and the base verdict of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACED_WORD))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).alias("host"),
        F.regexp_extract_all(text, F.lit(SPACED_WORD), 0).alias("words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own"))).alias("lines"),
    )
    rules = counted.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("lines.all") - F.col("lines.own")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.col("lines.all").cast("long").alias("n_lines"),
    )
    rules = rules.select("*", *[F.expr(fails).cast("long").alias(rule) for rule, fails in RULES.items()])
    return rules.withColumn("base_failed", sum(F.col(r) for r in BASE_RULES) > 0)


def host_rates(rules: DataFrame) -> DataFrame:
    """host, n_docs, broken (the rules that it breaks, comma-joined), and for each rule ``<rule>_mean`` and
    ``<rule>_low``: mean and lower bound of the host's shrunk rate.

    A rule's prior has the mean m and the variance v of the hosts' own rates, so its weight is m(1-m)/v - 1, held inside
    ``PRIOR_WEIGHTS``. All priors are one row.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(r).alias(r) for r in RULES])
    own = {r: F.col(r) / F.col("n_docs") for r in RULES}
    spread = [c for r in RULES for c in (F.avg(own[r]).alias(f"{r}_m"), F.coalesce(F.var_pop(own[r]), F.lit(0.0)).alias(f"{r}_v"))]
    low, high = (F.lit(w) for w in PRIOR_WEIGHTS)
    found = hosts.crossJoin(F.broadcast(hosts.agg(*spread)))
    for r in RULES:
        m, v = F.col(f"{r}_m"), F.col(f"{r}_v")
        weight = F.greatest(low, F.least(high, F.when(v > 0, m * (1 - m) / v - 1).otherwise(high)))
        found = found.withColumn(f"{r}_k", weight)
        found = found.withColumn(f"{r}_mean", (F.col(r) + m * F.col(f"{r}_k")) / (F.col("n_docs") + F.col(f"{r}_k")))
        deviation = F.sqrt(F.col(f"{r}_mean") * (1 - F.col(f"{r}_mean")) / (F.col("n_docs") + F.col(f"{r}_k") + 1))
        found = found.withColumn(f"{r}_low", F.col(f"{r}_mean") - DEVIATIONS * deviation)
    broken = [F.when(F.col(f"{r}_low") > F.greatest(F.lit(LEAST_RATE), RATIO * F.col(f"{r}_m")), F.lit(r)) for r in RULES]
    rates = [c for r in RULES for c in (f"{r}_mean", f"{r}_low")]
    return found.select("host", "n_docs", F.concat_ws(",", *broken).alias("broken"), *rates)


def quality_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """The counts, base_failed, host_broken (the rules that the row's host breaks), host_failed and kept of each row, and
    mean and lower bound of its host's shrunk rate of each rule, to six digits.

    Measures are written once and read twice. Only small columns reach the join with the hosts; Spark broadcasts the
    hosts where they are few, else a skewed host is split at run time.
    """
    rules = written(document_rules(docs, host), "quality-rules")
    rates = [f"{r}_{c}" for r in RULES for c in ("mean", "low")]
    hosts = host_rates(rules).select(
        F.col("host").alias("_host"), F.col("broken").alias("host_broken"), *[F.round(c, 6).alias(c) for c in rates]
    )
    joined = rules.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    failed = F.col("host_broken") != ""
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_broken",
        failed.alias("host_failed"), (~F.col("base_failed") & ~failed).alias("kept"), *rates,
    )


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


_LOW = "({r}_s - {d} * sqrt({r}_s * (1 - {r}_s) / (c + {r}_k + 1))) > greatest({least}, {ratio} * {r}_m)"


def _each(part: str) -> str:
    values = {"d": DEVIATIONS, "least": LEAST_RATE, "ratio": RATIO, "lo": PRIOR_WEIGHTS[0], "hi": PRIOR_WEIGHTS[1]}
    return ", ".join(part.format(r=r, fails=fails, **values) for r, fails in RULES.items())


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT *, [x FOR x IN ls IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS kept_lines FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT l.doc_id, source, len(ws)::BIGINT AS n_words,
             length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(kept_lines) - len(list_distinct(kept_lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, len(kept_lines)::BIGINT AS n_lines FROM l LEFT JOIN n USING (doc_id)),
b AS (SELECT *, {_each("({fails})::INT AS {r}")} FROM m),
h AS (SELECT source, count(*) AS c, {_each("sum({r}) AS {r}")} FROM b GROUP BY source),
p AS (SELECT {_each("avg({r} / c) AS {r}_m, var_pop({r} / c) AS {r}_v")} FROM h),
k AS (SELECT *, {_each("greatest({lo}, least({hi}, CASE WHEN {r}_v > 0 THEN {r}_m * (1 - {r}_m) / {r}_v - 1 ELSE {hi} END)) AS {r}_k")} FROM p),
s AS (SELECT *, {_each("({r} + {r}_m * {r}_k) / (c + {r}_k) AS {r}_s")} FROM h, k),
t AS (SELECT source, concat_ws(',', {_each("CASE WHEN " + _LOW + " THEN '{r}' END")}) AS host_broken,
      {_each("round({r}_s, 6) AS {r}_mean, round({r}_s - {d} * sqrt({r}_s * (1 - {r}_s) / (c + {r}_k + 1)), 6) AS {r}_low")} FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words + repeats > 0 AS base_failed, host_broken,
       host_broken <> '' AS host_failed, few_words + repeats = 0 AND host_broken = '' AS kept, {_each("{r}_mean, {r}_low")}
FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
"""
