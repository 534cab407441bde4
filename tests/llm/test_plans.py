"""What the plans of the built-in-only operators must and must not hold."""

import re

import pytest

from cohortry.llm import decontamination, quality, sharding
from tests.llm.cases import documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "documents.parquet")
    documents(spark).write.parquet(path)
    return spark.read.parquet(path)


def test_sharding_is_built_in_and_pruned(spark, docs):
    text = plan(sharding.document_shards(docs))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", text)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert read and all(set(x.split(":")[0] for x in r.split(",")) <= {"doc_id", "text"} for r in read)


def test_quality_and_decontamination_are_built_in(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    found = [
        plan(quality.document_rules(docs)),
        plan(quality.quality_verdicts(docs)),
        plan(decontamination.contamination(docs, bench)),
        plan(decontamination.prefix_hits(docs, decontamination.window_prefixes(decontamination.benchmark_windows(bench)), [5])),
    ]
    assert not any(re.search("Python|Pandas|Arrow|Cartesian", text) for text in found)
    assert all("source" not in r for r in re.findall(r"ReadSchema: struct<([^>]*)>", found[3]))


def test_decontamination_shuffles_no_texts(spark, docs):
    """The texts' side of the prefix join has no Exchange at all, and its join is a broadcast."""
    prefixes = spark.createDataFrame([(0, 0, 5, 13, 1)], "key long, at int, size int, length int, whole long")
    text = plan(decontamination.prefix_hits(docs, prefixes, [5]))
    assert "BroadcastHashJoin" in text and not re.search("(?<!Broadcast)Exchange", text)
