"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut by a hash of doc_id and text into blocks (at most ``MAX_BLOCKS``), the blocks get a permuted rank,
and a source's quota is a number of block draws: whole passes over all blocks, then the first ranks of one more pass,
then part of one boundary block. A tree halves the list of output shards again and again; at each node a multivariate
hypergeometric draw says how many of the node's draws go left from each source. So a leaf holds an exact count for each
source and takes a range of the source's permuted draws that no other leaf has; these ranges, and nothing else, say
which blocks are taken how often and where. Rows are ordered by a hash inside their shard.

The boundary draw is filled with documents in permuted order while they fit, from the boundary block and the
``SPREAD`` untaken blocks after it, so a long document there doesn't leave a gap that shorter ones could fill; one last
exchange of documents comes nearest to what is left.

Edge cases: a null or blank text has size 0 and is drawn with its block; a null source is a source of its own, the
last; an empty table gives an empty mix; rows without a doc_id, or that share one with another text, are drawn each by
themselves, rows of one source with equal doc_id and text together; if all sizes are 0 then nothing is taken; other
columns are kept by ``mixed_documents``, whatever their names, but for ``mix_shard``, ``mix_piece`` and ``mix_order``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import SPACED_WORD, table, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS = 50_000
MAX_BLOCKS = 4096
#: Words of a mix shard's piece: rows of a shard are in order, and cut into so many pieces that one can be sorted at a time.
PIECE_WORDS = 20_000_000
#: Blocks after the boundary block that may fill what is left of a source's quota.
SPREAD = 3


def n_spaced_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, no target above ``limit`` times its source.

    In order of limit/weight, the sources before some place are at their limit and the others share what is left, so
    the place is found by running sums. One row per source meets in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    ranked = per.withColumn("_rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")
    )
    ranked = ranked.withColumn("_w", weight).withColumn("_most", F.col("source_size") * float(limit))
    before = one.orderBy(F.col("_most") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(one) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / (
        F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("_share", share)
    level = F.min(
        F.when(
            F.col("_share") * F.col("_w") <= F.col("_most"),
            F.struct((F.col("_most") / F.col("_w")).alias("o"), F.col("_rank").alias("k"), F.col("_share").alias("s")),
        )
    ).over(one)["s"]
    return ranked.select(
        "source", "source_size", F.least(level * F.col("_w"), F.col("_most")).alias("target"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("int").alias("n_blocks"),
    )


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: each shard's share of every source's draws, all drawn together by halving the shards."""
    counts = np.zeros((shards, len(quotas)), dtype=np.int64)

    def down(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            counts[lo] = held
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        size = int(held.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(held, size, method="marginals") if size else np.zeros_like(held)
        down(lo, mid, left)
        down(mid, hi, held - left)

    down(0, shards, np.asarray(quotas, dtype=np.int64))
    return counts


def filled(sizes: np.ndarray, left: float) -> np.ndarray:
    """Which of the sizes are taken: in order while they fit, then the nearest to ``left`` of what one more, or one more
    for one less, can give."""
    takes = np.zeros(len(sizes), dtype=bool)
    for k, size in enumerate(sizes):
        if 0 < size <= left:
            takes[k] = True
            left -= size
    back = np.concatenate([[-1], np.flatnonzero(takes)])  # -1: nothing is given back
    given = np.where(back < 0, 0, sizes[back])
    order = np.argsort(given, kind="stable")
    best = (abs(left), -1, -1)
    for k in np.flatnonzero(~takes & (sizes > 0)):
        at = np.searchsorted(given[order], sizes[k] - left)
        for j in (at - 1, at):
            if 0 <= j < len(order):
                best = min(best, (abs(left - sizes[k] + given[order[j]]), int(k), int(back[order[j]])))
    if best[1] >= 0:
        takes[best[1]] = True
        if best[2] >= 0:
            takes[best[2]] = False
    return takes


def _unit() -> Column:
    """What is drawn together: a hash of doc_id and text, never null."""
    return F.xxhash64("doc_id", "text")


def _block(unit: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), unit), n_blocks).cast("int")


def mix_plan(docs: DataFrame, shards: int = 16, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, blocks, partial): sizes has each row's size, unit, target and block; targets has a row for each
    source; blocks has the draws [(pass, shard)] of each block that is drawn; partial has the units that the boundary
    draws take, each with its draw.

    blocks has at most ``MAX_BLOCKS`` rows for a source. A boundary draw is filled in one task from 1 + ``SPREAD`` blocks
    of its source, each about 1/``MAX_BLOCKS`` of it, or ``BLOCK_WORDS`` words.
    """
    sizes = written(docs.select("doc_id", "source", n_spaced_words(F.col("text")).alias("size"), _unit().alias("unit")), "mix-sizes")
    targets = written(source_targets(sizes), "mix-targets")
    sizes = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sizes = sizes.withColumn("block", _block(F.col("unit"), F.col("n_blocks"), seed))
    by_source = Window.partitionBy("source")
    mixed = F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("block"))
    blocks = (
        sizes.groupBy("source", "block")
        .agg(
            F.sum("size").alias("words"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
        )
        .withColumn("rank", F.row_number().over(by_source.orderBy(mixed, "block")) - 1)
        .withColumn("to", F.sum("words").over(by_source.orderBy("rank")))
        .withColumn(
            "passes",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"),
        )
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("extra", ((F.col("to") <= F.col("rest")) & (F.col("rest") > 0)).cast("int"))
        .withColumn("done", F.when(F.col("extra") == 1, F.col("to")).otherwise(0))
    )
    blocks = written(blocks.select("source", "block", "rank", "passes", "rest", "extra", "done"), "mix-blocks")
    # the first `whole` ranks of the last pass are drawn whole; the next one is the boundary, where something is left
    quotas = blocks.groupBy("source").agg(
        F.count("*").alias("nb"), F.first("passes").alias("passes"), F.sum("extra").alias("whole"),
        (F.first("rest") - F.max("done")).alias("left"),
    )
    part = ((F.col("left") > 0) & (F.col("whole") < F.col("nb"))).cast("int")
    quotas = written(quotas.withColumn("part", part).withColumn("draws", F.col("passes") * F.col("nb") + F.col("whole") + F.col("part")), "mix-quotas")

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last").reset_index(drop=True)
        counts = split_tree(rows["draws"].to_numpy(), shards, seed)
        first = np.cumsum(counts, axis=0) - counts
        return pd.DataFrame(
            {
                "source": np.tile(rows["source"].to_numpy(dtype=object), shards),
                "shard": np.repeat(np.arange(shards, dtype=np.int32), len(rows)),
                "first": first.ravel(),
                "n": counts.ravel(),
            }
        )

    # one row per source in, one per source and shard out
    leaves = quotas.select("source", "draws").groupBy(F.lit("all")).applyInPandas(tree, "source string, shard int, first long, n long")
    of = quotas.select(F.col("source").alias("_s"), "nb", "passes", "whole", "part")
    drawn = leaves.filter("n > 0").join(of, F.col("source").eqNullSafe(F.col("_s")))
    drawn = drawn.withColumn("draw", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    at = F.struct(F.floor(F.col("draw") / F.col("nb")).cast("int").alias("pass"), "shard")
    boundary = (F.col("part") == 1) & (F.col("draw") == F.col("passes") * F.col("nb") + F.col("whole"))
    drawn = drawn.select("source", (F.col("draw") % F.col("nb")).cast("int").alias("rank"), at.alias("at"), boundary.alias("boundary"))
    drawn = written(drawn, "mix-drawn")
    by_rank = drawn.filter("not boundary").groupBy(F.col("source").alias("_s"), F.col("rank").alias("_r")).agg(
        F.sort_array(F.collect_list("at")).alias("draws")
    )
    ranks = blocks.select("source", "block", "rank")
    full = ranks.join(by_rank, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r"))).select("source", "block", "draws")
    full = written(full, "mix-draws")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "order", "unit"])
        return rows[filled(rows["size"].to_numpy(), float(rows["left"].iloc[0]))][["source", "unit"]]

    last = drawn.filter("boundary").select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "at")
    lefts = quotas.filter("part = 1").select(F.col("source").alias("_q"), "left")
    last = last.join(lefts, F.col("_s").eqNullSafe(F.col("_q"))).drop("_q")
    near = F.col("source").eqNullSafe(F.col("_s")) & F.col("rank").between(F.col("_r"), F.col("_r") + SPREAD)
    around = ranks.join(last, near).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "rank", "left", "at")
    fillers = sizes.join(around, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    fillers = fillers.groupBy("source", "rank", "unit", "left").agg(F.sum("size").alias("size"))
    fillers = fillers.withColumn("order", F.xxhash64(F.lit(seed + 2), F.col("unit")))
    taken = fillers.groupBy("source").applyInPandas(fill, "source string, unit long")
    partial = written(taken.join(last.select("_s", "at"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-part")
    return sizes, targets, full, partial


def _with_draws(rows: DataFrame, blocks: DataFrame, partial: DataFrame) -> DataFrame:
    """Adds ``draws`` to rows that have source, unit and block."""
    b = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("draws").alias("_d"))
    p = partial.select(F.col("source").alias("_ps"), F.col("unit").alias("_pu"), F.col("at").alias("_at"))
    rows = rows.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("unit") == F.col("_pu")), "left")
    none = F.array().cast(b.schema["_d"].dataType)
    whole, last = F.coalesce("_d", none), F.when(F.col("_at").isNotNull(), F.array("_at")).otherwise(none)
    return rows.withColumn("draws", F.concat(whole, last)).drop("_s", "_b", "_d", "_ps", "_pu", "_at")


def mix_counts(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), draws."""
    sizes, _, blocks, partial = mix_plan(docs, shards, seed)
    return _with_draws(sizes, blocks, partial).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.to_json("draws").alias("draws"),
    )


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each draw of a row, with ``mix_shard``, ``mix_piece`` (ranges of
    the order) and ``mix_order``."""
    _, targets, blocks, partial = mix_plan(docs, shards, seed)
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    pieces = max(1, -(-words // (shards * PIECE_WORDS)))
    of = targets.select(F.col("source").alias("_us"), "n_blocks")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_piece", "mix_order")])
    rows = docs.select(kept.alias("row"), "source", _unit().alias("unit"))
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("_us")), "left")
    rows = _with_draws(rows.withColumn("block", _block(F.col("unit"), F.col("n_blocks"), seed)), blocks, partial)
    order = F.xxhash64(F.lit(seed + 3), F.col("unit"), F.col("draw.pass")).alias("mix_order")
    rows = rows.select("row", F.explode("draws").alias("draw"), "unit").select("row", "draw", order)
    piece = F.least(F.lit(pieces - 1), F.floor((F.col("mix_order") / float(1 << 64) + 0.5) * pieces)).cast("int")
    return rows.select("row.*", F.col("draw.shard").alias("mix_shard"), piece.alias("mix_piece"), "mix_order")


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
