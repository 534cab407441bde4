"""Queries with SQL against DuckDB, and held-out quality of what is learned, on the driver's tables."""

import hashlib
import zlib
from pathlib import Path

import pytest

from cohortry.llm import language, licenses, queries, secrets, toxicity
from tests.llm.test_small_tables import base_spans, license_base
from tests.test_queries import DATA, TABLES, cells  # noqa: F401
from tests.test_queries import duck  # noqa: F401

LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(LARGER).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert cells(df.collect(), df.columns) == cells(want.fetchall(), names)


def test_base_licenses_and_secrets_of_every_row(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "source")
    text = {r.doc_id: r.text for r in docs.collect()}
    found = licenses.scan_licenses(docs).collect()
    assert len(found) == len(text) and any(r.labels != r.base_labels for r in found)
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_base(text[r.doc_id])
    spans = secrets.secret_digests(docs).collect()
    assert len(spans) == len(text)
    for r in spans:
        assert r.base_sha256 == hashlib.sha256(base_spans(text[r.doc_id]).encode()).hexdigest()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.document_languages(docs).collect()
    assert len(got) == len(lang)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.document_toxicity(docs, labels).collect() if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    assert right >= 0.9 * len(held)
