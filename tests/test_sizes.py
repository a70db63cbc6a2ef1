"""What plans send where: nothing that grows with the data goes through the driver."""

import json
import re

import pytest

import __spark_entry__ as entry
from quoteloom.operators import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["judged_actions", "refused_actions", "review_history", "reviewed_cells", "row_approvals", "approved_rows"])
def test_review_never_broadcasts_cells_or_actions(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if " Join " in line]
    growing = [line for line in joins if re.search(r"\b(study|user_id)#", line)]  # the others look up a column of the codebook
    assert growing and all("strategy=merge" in line for line in growing)


def test_codings_are_numbered_before_their_values_are_derived(spark):
    """The shuffle of the row numbers carries columns of the table alone, and rules on some values build no map of all."""
    plan = entry.queries()["rule_v16"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "CASE WHEN" not in below and "map(" not in plan


def test_compared_texts_keep_any_character(spark):
    texts = [None, "", "\x01", "\x02", "\x02a", "\x02b", "\x02n", "a\x01b\x02", " a", "a,b"]
    cell = "struct<kind:string,num:double,str:string>"
    rows = [("p", "e", i, {"Estudio": ("int", float(i), None), "t": ("null", None, None) if t is None else ("str", None, t), "n": ("float", 0.1 + i, None)}, ("x",))
            for i, t in enumerate(texts)]
    kind = f"project_id string, extraction_id string, row_pos int, fila map<string,{cell}>, traz struct<m:string>"
    a = spark.createDataFrame(rows, kind)
    b = spark.createDataFrame([(*r[:3], {**r[3], "n": ("int", float(r[2]), None)}, r[4]) for r in rows], kind)
    got = {(r.row_pos, r.field): r for r in compare.compare_codings(a, b, ["t", "n", "none"], ["m"]).collect()}
    for i, t in enumerate(texts):
        assert got[i, "t"].equal and got[i, "none"].equal and got[i, "m"].equal and got[i, "n"].equal is False
        assert json.loads(got[i, "t"].a) == t == json.loads(got[i, "t"].b) and (got[i, "n"].a, got[i, "n"].b) == (repr(0.1 + i), str(i))
    assert compare.agreement_of(a, b, ["t", "n", "none"], ["m"]).first()[2:4] == (41, 31)


@pytest.mark.parametrize("name", ["compared_codings", "low_agreement", "gold_comparison", "findings_table"])
def test_codings_are_compared_where_they_were_numbered(spark, name):
    """Only columns of the table are shuffled: the cells of a row are not dealt out anew by extraction and row, nor is its evidence."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = re.findall(r"Exchange hashpartitioning\((.*)", plan)
    assert dealt and not any("row_pos" in by for by in dealt)


def test_compared_rows_pair_as_in_a_join(spark):
    """A place taken twice gives all its pairs; rows without a key pair with none, but count as rows."""
    cell = "struct<kind:string,num:double,str:string>"
    kind = f"project_id string, extraction_id string, row_pos int, fila map<string,{cell}>, traz struct<m:string,evidencia:map<string,array<string>>>"

    def coding(*rows):
        return spark.createDataFrame([("p" if i else None, "e", i, {"t": ("str", None, t)}, ("x", {"t": [t]})) for i, t in rows], kind)

    a, b = coding((1, "x"), (1, "y"), (2, "z"), (0, "k"), (3, "only a")), coding((1, "x"), (1, "w"), (2, "z"), (0, "k"), (4, "only b"))
    got = sorted((r.row_pos, r.a, r.b, r.equal, r.proof) for r in compare.compare_codings(a, b, ["t"], [], proofs=True).filter("row_pos is not null").collect())
    assert got == [(1, '"x"', '"w"', False, '["w"]'), (1, '"x"', '"x"', True, None), (1, '"y"', '"w"', False, '["w"]'), (1, '"y"', '"x"', False, '["x"]'), (2, '"z"', '"z"', True, None)]
    both = {r.project_id: tuple(r)[2:4] for r in compare.agreement_of(a, b, ["t"], []).collect()}
    assert both == {"p": (6, 3), None: (1, 1)}


@pytest.mark.parametrize("name", ["agreement", "compared_codings", "escalated_coding", "gold_comparison"])
def test_compared_values_are_taken_without_building_them(spark, name):
    """No record of a compared value is built or joined to a text only to be taken apart again."""
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    values = plan[:plan.index("Window")]
    assert "arrays_zip" in plan or "filter(" in plan
    assert not re.search(r"split\(|cast\(struct|array\(struct|v:Muestra", values)
