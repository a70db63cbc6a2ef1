"""Cases of review findings, each on a small table."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quoteloom.operators import review

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def _same(spark, name, folder, *tables):
    """Rows of a query, which have to be those of its SQL."""
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = db.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def _documents(folder, rows):
    pq.write_table(pa.Table.from_pylist([dict(zip(DOCUMENTS.names, (i, x, lang, "s", len(x or "")), strict=True)) for i, x, lang in rows], DOCUMENTS), f"{folder}/documents.parquet")


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    rows = [(i, f"text {i % 3}", "en", "s", 6) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in entry.queries()["stream_dedup"](spark, str(tmp_path)).collect()] == [("en", 3)]


def test_stream_dedup_counts_files_of_any_number(spark, tmp_path):
    _documents(tmp_path, [(0, "alone", "en"), (-5, "before", "en"), (3, "copy", "de"), (3 + 10**12, "copy", "de"), (10**17, "far", "de"), (None, "no number", "fr"),
                          (7, None, "fr"), (8, None, "es")])
    assert dict(_same(spark, "stream_dedup", tmp_path, "documents")) == {"en": 2, "de": 2, "fr": 1, "es": 0}


def test_pipeline_removes_near_duplicates_by_fingerprints(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        text = rng.sample(words, 200)
        rows += [(3 * i, " ".join(text), "en"), (3 * i + 1, " ".join(text[:200 - i % 8] + ["x"] * (i % 8)), "en"), (3 * i + 2, "\n".join(text).upper(), "en")]
    rows += [(500, None, "en"), (501, "", "en"), (502, "one", "en"), (None, "no number", "en")]
    _documents(tmp_path, rows)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, str(tmp_path)).collect()]
    classes = entry.queries()["op5_simhash"](spark, str(tmp_path)).collect()
    want = [r["doc_id"] for r in classes if r["doc_id"] == r["component_id"]]
    assert sorted(got, key=str) == sorted(want, key=str) and 40 < len(want) < len(rows) - 40


def test_codebooks_are_derived_from_documents_once(spark, tmp_path):
    text = "alpha beta gamma delta epsilon zeta eta"
    _documents(tmp_path, [(i, text[: 10 * i], "en") for i in range(5)] + [(7, None, "de"), (8, "una dos tres cuatro cinco seis siete ocho", "es")])
    for name in ("rules_for_fields", "named_trace_fields", "header_notes"):
        assert len(_same(spark, name, tmp_path, "documents")) > 0
        assert not any("documents.parquet" in f for f in entry.queries()[name](spark, str(tmp_path)).inputFiles())


@pytest.mark.parametrize("late", [False, True])
def test_an_action_with_the_number_of_a_request_comes_after_it(spark, monkeypatch, late):
    """Every view of the events table is both; in whatever order rows arrive, a request reads what was before it."""
    carry = review.carry_last

    def dealt(df, *args, **more):
        done = F.col("_done").isNotNull()
        return carry(df.coalesce(1).sortWithinPartitions(done if late else ~done), *args, **more)

    monkeypatch.setattr(review, "carry_last", dealt)
    cells = spark.createDataFrame([("p", s, "t", "PENDIENTE") for s in (1, 2)], "project_id string, study long, key string, review_state string")
    columns = spark.createDataFrame([("p", "t", 1, True)], "project_id string, key string, position int, is_numeric boolean")
    requests = spark.createDataFrame([("p", s, n, "ana") for s in (1, 2) for n in (5, 5, 9, 12)], "project_id string, study long, seq long, author string")
    actions = [("p", 1, 5, "APROBAR"), ("p", 1, 9, "RECHAZAR"), ("p", 1, 12, "APROBAR"), ("p", 2, 9, "APROBAR")]
    done = spark.createDataFrame([(p, s, "t", n, a, None) for p, s, n, a in actions], "project_id string, study long, key string, seq long, action string, refusal string")
    got = sorted(tuple(r)[1:] for r in review.row_approvals(requests, cells, columns, done).collect())
    assert got == [(1, 5, False, "t"), (1, 9, True, ""), (1, 12, False, "t"), (2, 5, False, "t"), (2, 9, False, "t"), (2, 12, True, "")]
