"""Sheet rows of many small projects: no call to Python for each of them."""

import random

from quoteloom.operators import export


def test_small_projects_share_batches_and_may_run_over_them(spark):
    rng = random.Random(5)
    rows = [(f"p{p}", s, rng.choice([None, s + 2, rng.randrange(-1, 9)])) for p in range(300) for s in range(rng.randrange(1, 9))]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "5")
    try:
        out = export.place_inherited(spark.createDataFrame(rows, "project_id string, study long, origin_row int"))
        assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.project_id, r.study): r.sheet_row for r in out.collect()}
    finally:
        spark.conf.set(limit, before)
    assert len(got) == len(rows)
    for p in {r[0] for r in rows}:
        used: list[int] = []
        for _, study, origin in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            used.append(origin if origin is not None and origin not in used else min(set(range(2, 100)) - set(used)))
            assert got[p, study] == used[-1]
