"""The pipeline over a small corpus with planted cases, and its stages on odd rows."""

from __future__ import annotations

import random

import corpus_pipeline
from quoteloom.session import shared_folder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _ql_row string, id long, key string"


def _corpus():
    rng = random.Random(21)
    stops = "the of and to in is that for it was".split()
    vocabulary = ["".join(rng.choice("abcdeilmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(3000)]

    def prose(n):
        words = [rng.choice(stops) if rng.random() < 0.35 else rng.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(words[i: i + 14]) + "." for i in range(0, n, 14))

    docs = {i: prose(120) for i in range(300)}
    labels = {i: (1, 0) for i in range(0, 300, 2)}
    for i in range(300, 420):  # shouting, every other one labelled
        docs[i] = " ".join(w.upper() + "!!" for w in prose(80).split())
        labels.update({i: (0, 0)} if i % 2 else {})
    for i in range(420, 540):
        words = prose(120).split(" ")
        for at in rng.sample(range(len(words)), 4):
            words[at] = rng.choice(["idiot", "moron", "scum", "zorgala", "zorgami"])
        docs[i] = " ".join(words)
        labels.update({i: (1, 1)} if i % 2 else {})
    item = prose(60).replace("\n", " ")
    docs[600] = prose(60) + "\n" + item
    passage = prose(56).replace("\n", " ")
    for i in range(10):
        docs[i] += "\n" + passage
    docs[700] = docs[50].replace("\n", " ")  # one line: lines do not repeat, shingles do
    return docs, labels, item, passage


def _write(spark, docs, labels, item):
    folder = shared_folder(spark)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", None, "k") for i, t in docs], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_planted_cases_go_and_clean_documents_stay(spark):
    docs, labels, item, passage = _corpus()
    folder = _write(spark, docs.items(), labels, item)
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns
        out.write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r for r in rows.collect()}
    kept = seen["quality_classifier"]
    assert sum(i in kept for i in range(300, 540)) <= 6 and sum(i not in kept for i in range(300)) <= 3
    held = [i for i, r in seen["line_dedup"].items() if passage in r["text"]]
    assert held == [min(i for i in range(10) if i in kept)]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].values())
    assert 700 not in seen["near_dedup"] and 50 in seen["near_dedup"]
    assert 600 in seen["near_dedup"] and 600 not in seen["decontamination"]
    last = seen["decontamination"]
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect()
    assert {r["doc_id"] for r in packed} == set(last)
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].encode()) + 1 for r in last.values())


def test_stages_on_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "no id"), (5, "word " * 30_000), (6, None)]
    for rows in (odd, []):
        folder = _write(spark, rows, {}, "a benchmark item")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == bool(rows)
        table = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, folder).columns == table.columns
