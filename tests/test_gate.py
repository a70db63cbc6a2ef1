"""The schema gate and the rules behind it deal out what they found, not the coded rows."""

import re

import duckdb

from quoteloom.operators import rules
from quoteloom.plans.catalogue import oracle_sql, queries
from quoteloom.plans.derived import FILA
from quoteloom.schemas import TRACE_FIELDS
from quoteloom.functions.typed import CELL_TYPE

FOLDER = "/root/testdata/sf0.001"


def _plan(spark, name):
    """Plan under a limit for broadcasts that the tables exceed, as larger ones exceed the usual limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        return queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_schema_gate_deals_no_row_by_project(spark):
    assert not re.search(r"hashpartitioning\(project_id#\d+(, key#\d+)?, \d+\)", _plan(spark, "schema_gate").toString())


def test_validated_rows_deals_out_no_values_of_rows(spark):
    plan = _plan(spark, "validated_rows")

    def exchanged(node):
        if node.nodeName() == "Exchange":
            yield node.output().mkString(" ")
        for i in range(node.children().size()):
            yield from exchanged(node.children().apply(i))

    dealt = list(exchanged(plan.initialPlan()))
    assert dealt and not [x for x in dealt if "fila#" in x or "traz#" in x or "document_level#" in x]
    assert not re.search(r"hashpartitioning\(project_id#\d+, \d+\)", plan.toString())


def test_cell_fills_deals_no_row_by_project(spark):
    assert not re.search(r"hashpartitioning\(project_id#\d+, \d+\)", _plan(spark, "cell_fills").toString())


def test_faults_of_odd_codebooks_and_rows(spark):
    trace = ", ".join(f"`{n}` {k}" for n, k in TRACE_FIELDS.items())
    rows = spark.createDataFrame(
        [("p", "e", "d", 0, {"A": ("str", None, "x"), "B": None}, None), ("p", "e", "d", 1, None, None), ("q", "f", "d", 0, {"A": ("int", 1.5, None)}, None)],
        f"project_id string, extraction_id string, doc_id string, row_pos int, fila map<string,{CELL_TYPE}>, traz struct<{trace}>")
    columns = spark.createDataFrame(
        [("p", "A", "entero", True, None), ("p", "A", "texto", False, ["x"]), ("p", "B", "texto", True, None), ("p", "C", "texto", False, []), ("p", None, "texto", False, None)],
        "project_id string, key string, data_type string, required boolean, allowed array<string>")
    got = sorted((r.project_id, r.row_pos, r.column, r.message) for r in rules.schema_violations(rows, columns).collect())
    assert got == [("p", 0, "A", "type"), ("p", 0, "B", "required"), ("p", 0, "C", "missing key"), ("q", 0, "A", "unknown column")]


def test_cell_fills_give_every_column_of_every_row(spark):
    """One cell per column of the codebook and row, under refuted and unverifiable findings alike."""
    got = queries()["cell_fills"](spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{FOLDER}/lineitem.parquet'")
        want = db.execute(f"SELECT key, fill, count(*) FROM ({oracle_sql()['cell_fills']}) GROUP BY ALL").fetchall()
    counts = [tuple(r) for r in got.groupBy("key", "fill").count().collect()]
    assert sorted(counts, key=str) == sorted(want, key=str)
    assert len({k for k, _, _ in want}) == len(FILA) and sum(c for _, _, c in want) == n * len(FILA)


def _exchanged(node):
    if node.nodeName() == "Exchange":
        yield node.output().mkString(" ")
    for i in range(node.children().size()):
        yield from _exchanged(node.children().apply(i))


def test_assembled_cells_deal_out_lines_not_values(spark):
    dealt = list(_exchanged(_plan(spark, "assembled_cells").initialPlan()))
    assert dealt and not [x for x in dealt if "fila#" in x or "traz#" in x]
