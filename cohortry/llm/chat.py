"""Preference formatting: the longest common turn prefix is the prompt, what follows are two masked completions.

Input rows are turns: (pair_id, side, turn, role, text), side ``chosen`` or ``rejected``. Turns of both sides are lined
up by their rank in their conversation; the prompt ends before the first rank where role or text differ or one side has
no turn. It is rendered once. A completion's mask lists the code-point spans, counted from the completion's start, that
a loss may use: the text and end mark of assistant turns. Lengths are running sums, so work is in proportion to turns.

Edge cases: turns of any length are rendered whole; a null role or text is an empty string; turns of one side that share their number are ordered by role and
text; a pair that lacks a side has an empty prompt and one empty completion; equal sides have a whole prompt and two
empty completions; a turn that repeats counts each time; a null turn number comes first; rows with a null pair_id or
side are left out; an empty table gives no pair; other columns are ignored, whatever their names. A conversation is one string in the end, so its turns meet in one row, as they do in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import table

OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
TRAINED = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column, before: Column) -> Column:
    """start:end of each trained span, comma-joined; ``before`` is what was rendered before the first of these turns."""
    head = len(OPEN) + len(MIDDLE)

    def span(t: Column) -> Column:
        last = t["upto"] - before
        return F.concat_ws(":", last - F.length(rendered(t)) + head + F.length(t["role"]), last)

    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == TRAINED), span), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask: one row per pair."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    kept = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    rows = kept.select("pair_id", "side", "turn", role, text)
    # lengths run over the chosen side, then the rejected one, so that one shuffle by pair serves sums and arrays
    line = Window.partitionBy("pair_id").orderBy("side", "turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.length(rendered(F.struct("role", "text")))).over(line))
    one = F.struct("turn", "role", "text", "upto")
    sides = (
        rows.groupBy("pair_id")
        .agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, one))).alias(s) for s in ("chosen", "rejected")])
    )

    def same(x: Column, y: Column) -> Column:
        return (x["role"] == y["role"]) & (x["text"] == y["text"])

    both = F.least(F.size("chosen"), F.size("rejected"))
    equal = F.zip_with("chosen", "rejected", same)
    first = F.array_position(F.transform(equal, lambda e: F.coalesce(e, F.lit(False))), False).cast("int")
    prompt_turns = F.when(first > 0, first - 1).otherwise(both)
    cut = sides.withColumn("n_prompt_turns", prompt_turns)
    rest = {s: F.slice(s, F.col("n_prompt_turns") + 1, F.size(s)) for s in ("chosen", "rejected")}
    prompt, whole = F.get("chosen", F.col("n_prompt_turns") - 1)["upto"], F.get("chosen", F.size("chosen") - 1)["upto"]
    cut = cut.withColumn("before_chosen", F.coalesce(prompt, F.lit(0)))
    cut = cut.withColumn("before_rejected", F.col("before_chosen") + F.coalesce(whole, F.lit(0)))
    return cut.select(
        "pair_id", "n_prompt_turns", _joined(F.slice("chosen", 1, F.col("n_prompt_turns"))).alias("prompt"),
        *[c for s in ("chosen", "rejected") for c in (_joined(rest[s]).alias(s), _mask(rest[s], F.col(f"before_{s}")).alias(f"{s}_mask"))],
    )


def drawn_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: chosen is the conversation itself; rejected has the same turns up to
    the last assistant turn, which the conversation's first user turn replaces (an answer that parrots the question).

    A conversation without an assistant turn has equal sides.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    marks = turns.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == TRAINED, F.col("turn"))).alias("last"),
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("asked"),
    )
    turns = turns.join(marks, "conv_id")
    chosen = F.struct(F.lit("chosen").alias("side"), F.col("text"))
    replaced = F.when(F.col("turn") == F.col("last"), F.coalesce("asked.text", F.lit(""))).otherwise(F.col("text"))
    kept = F.col("last").isNull() | F.col("turn").isNull() | (F.col("turn") <= F.col("last"))
    rejected = F.when(kept, F.struct(F.lit("rejected").alias("side"), replaced.alias("text")))
    sides = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(F.array(chosen, rejected)).alias("s"))
    return sides.filter("s is not null").select("pair_id", "s.side", "turn", "role", "s.text")


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(drawn_pairs(table(spark, sf_dir, "conversations")))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last,
             arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS asked FROM t GROUP BY conv_id),
s AS (SELECT conv_id, turn, role, text, 'chosen' AS side FROM t
      UNION ALL
      SELECT conv_id, turn, role, CASE WHEN turn = last THEN coalesce(asked, '') ELSE text END, 'rejected'
      FROM t JOIN m USING (conv_id) WHERE last IS NULL OR turn <= last),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS k,
             '<|turn|>' || role || chr(10) || text || '<|end|>' || chr(10) AS line FROM s),
d AS (SELECT conv_id, coalesce(a.k, b.k) AS k
      FROM (SELECT * FROM r WHERE side = 'chosen') a FULL JOIN (SELECT * FROM r WHERE side = 'rejected') b USING (conv_id, k)
      WHERE a.line IS DISTINCT FROM b.line),
p AS (SELECT conv_id, coalesce(min(d.k) - 1, any_value(n)) AS n
      FROM (SELECT conv_id, max(k) AS n FROM r WHERE side = 'chosen' GROUP BY conv_id) LEFT JOIN d USING (conv_id) GROUP BY conv_id),
c AS (SELECT r.*, p.n, sum(CASE WHEN k > n THEN length(line) ELSE 0 END) OVER (PARTITION BY r.conv_id, side ORDER BY k) - length(line) AS place
      FROM r JOIN p USING (conv_id)),
f AS (SELECT conv_id, side, any_value(n)::INT AS n, coalesce(string_agg(line, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
             coalesce(string_agg(line, '' ORDER BY k) FILTER (k > n), '') AS rest,
             coalesce(string_agg((place + 9 + length(role))::BIGINT || ':' || (place + length(line))::BIGINT, ',' ORDER BY k)
                      FILTER (k > n AND role = 'assistant'), '') AS mask
      FROM c GROUP BY conv_id, side)
SELECT a.conv_id AS pair_id, a.n AS n_prompt_turns, a.prompt, a.rest AS chosen, a.mask AS chosen_mask, b.rest AS rejected, b.mask AS rejected_mask
FROM f a JOIN f b USING (conv_id) WHERE a.side = 'chosen' AND b.side = 'rejected'
"""
