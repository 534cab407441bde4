"""A corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing to weights, sharding.

Each stage is one operator over all that its predecessor kept. Every stage but the last returns the columns of
``documents``.

A document is a row, known by its doc_id and its text, not by its doc_id alone. A null doc_id is no id: rows without one
are documents of their own, judged and dropped by their texts, as are rows of one doc_id with different texts. Rows
equal in doc_id and text (nulls equal nulls) are one document, of which the near-duplicate stage keeps one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import table, written
from cohortry.llm.decontamination import row_contamination
from cohortry.llm.language import UNKNOWN, fit_network, identify_languages
from cohortry.llm.minhash import near_duplicates
from cohortry.llm.mixing import mixed_documents
from cohortry.llm.sharding import document_shards, row_numbers

#: A document is rejected if no language can be told or the best one is less likely than this. With four learned languages
#: the best is at least 0.25, so in effect only texts without a letter are rejected (README, Bounds).
LEAST_SCORE = 0.3
#: Keys of dropped documents that are broadcast at most (8 or 16 bytes each).
MOST_IDS = 1_000_000


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= MOST_IDS else keys


def rows_of(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that no name of the caller's meets one of ours, with doc_id and text beside."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def without(rows: DataFrame, dropped: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """``rows`` (of ``rows_of``) less those whose keys equal those of a row of ``dropped``, null-safe, as the caller's
    columns; texts are shuffled only if the dropped rows are too many. ``keys`` says, by the column's name in
    ``dropped``, what a row has for it."""
    gone = written(dropped.select(*[F.col(k).alias(f"gone_{k}") for k in keys]).distinct(), name)
    same = reduce(lambda a, b: a & b, [of.eqNullSafe(F.col(f"gone_{k}")) for k, of in keys.items()])
    return rows.join(_few(gone), same, "left_anti").select("row.*")


def numbered_documents(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text (the smallest in the other columns) as ``rows_of`` has it, with ``number``, a
    number of its own.

    That is the doc_id, except where a row has none or shares it with another text: then the text of the smallest hash
    has the doc_id, and all others get numbers beyond the largest doc_id (below the smallest where none are left), so
    in a group of near copies a row with its doc_id as number stays before the others (after them where none are left).
    Only rows that have no id or a repeated one are shuffled with their texts.
    """
    rows, print_ = rows_of(docs), F.xxhash64("text")
    repeated = (
        docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), print_.alias("print"))
        .groupBy("id").agg(F.count("*").alias("n"), F.min("print").alias("least"))
        .filter("n > 1").select("id", "least")
    )
    few = _few(written(repeated, "repeated-ids"))
    known, unknown = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    odd = known.join(few, F.col("doc_id") == F.col("id")).drop("id")
    odd = odd.unionByName(unknown.withColumn("least", F.lit(None).cast("long")))
    odd = odd.groupBy("doc_id", "text", "least").agg(F.min("row").alias("row"))
    odd = written(odd.select("row", "doc_id", "text", print_.eqNullSafe(F.col("least")).alias("own")), "odd-documents")
    number = F.col("doc_id").cast("long").alias("number")
    every = ["row", "doc_id", "text"]
    alone = known.join(few, F.col("doc_id") == F.col("id"), "left_anti").select(*every, number)
    if odd.isEmpty():
        return alone
    others = odd.filter("not own")
    n, (least, most) = others.count(), docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    start = 0 if most is None else most + 1 if most < (1 << 63) - 1 - n else least - n
    dealt = row_numbers(others.select(*every, print_.alias("print")), ["print", "doc_id", "text"])
    new = written(dealt.select(*every, (F.col("_row") + F.lit(start).cast("long")).alias("number")), "odd-numbered")
    return alone.union(odd.filter("own").select(*every, number)).union(new)


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told."""
    rows = rows_of(docs).select("row", "text")
    told = identify_languages(rows, fit_network(docs), ["row"])
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    rows = numbered_documents(docs)
    copies = near_duplicates(rows.select(F.col("number").alias("doc_id"), "text")).filter("not kept")
    return without(rows, copies, {"doc_id": F.col("number")}, "dropped-near")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    found = row_contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return without(rows_of(docs), found, {"doc_id": F.col("doc_id"), "print": F.xxhash64("text")}, "dropped-benchmark")


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it. Rows of a piece of a mix shard (all of a small one) lie in one
    partition, together and in the mix's order, and are written so."""
    held = rows_of(docs).select("row", "doc_id", "text", "row.source")
    mixed = mixed_documents(held).repartition("mix_shard", "mix_piece")
    return mixed.sortWithinPartitions("mix_shard", "mix_order", "doc_id", F.xxhash64("text")).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return document_shards(docs)


STAGES = [
    ("language", told_language),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_to_weights),
    ("sharding", sharded),
]

#: A trained network, hashed signatures and hashed draws can't be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
