"""What several text operators share: shared-folder tables, word rules and small column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Words between white space, and words of ASCII letters, digits and every non-ASCII code point.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: The same two rules on UTF-8 bytes: every byte of a non-ASCII code point is 0x80 or above.
PLAIN_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"cohortry-{os.getuid()}")
    return f"file://{path}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cohortry/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there, and a lost executor costs
    no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is read in less than half as many pieces: a small table, or one large file, would
    keep most cores idle. A table of more pieces is left as it is, so large ones aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of the rows that the job which writes them takes on the way."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = written(df.observe(seen, *[m.alias(n) for n, m in measures.items()]), name)
    return out, seen.get


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows."""
    out, found = measured(df, name, n=F.count(F.lit(1)))
    return out, found["n"]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    _delete(df.sparkSession, df.written_path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has left for this application; results that weren't saved are lost."""
    _delete(spark, _own_folder(spark))


def hash_sample(df: DataFrame, key: str, n: int, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows of about ``n``: those whose hash of ``key`` is smallest, with that hash as ``_hash``.

    Hashes beyond the expected bound are dropped first, so that no more than about ``limit`` rows are sorted or sent,
    from however many partitions.
    """
    share = min(1.0, (limit + 6 * limit**0.5) / max(n, 1))
    most = (1 << 63) - 1
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit(most)))
    return hashed.filter(F.col("_hash") <= F.lit(int(share * most) if share < 1 else most)).orderBy("_hash", key).limit(limit)


def group_sample(df: DataFrame, key: str, group: str, counts: dict, limit: int, seed: int) -> DataFrame:
    """``hash_sample`` inside each group: at most ``limit`` rows of each, given how many rows each group has."""
    most = (1 << 63) - 1
    share = {g: min(1.0, (limit + 6 * limit**0.5) / n) for g, n in counts.items()}
    bounds = [x for g, p in share.items() for x in (F.lit(g), F.lit(int(p * most) if p < 1 else most).cast("long"))]
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit(most)))
    hashed = hashed.filter(F.col("_hash") <= F.element_at(F.create_map(*bounds), F.col(group)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_hash", key))
    return hashed.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def plain_words(text: Column) -> Column:
    """The text's words of ``PLAIN_WORD``, A-Z in lower case: other ASCII characters become blanks, then blanks split."""
    blank = F.translate(F.coalesce(text, F.lit("")), UPPER + NO_WORD, LOWER + " " * len(NO_WORD))
    return F.array_remove(F.split(blank, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
