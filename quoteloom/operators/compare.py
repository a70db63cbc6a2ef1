"""Double coding: field by field comparison, agreement, and congruence of two matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import json_value_text, norm
from quoteloom.functions.typed import CELL_TYPE, cell_json, cells_equal, null_cell, text_cell
from quoteloom.vocab import AGREEMENT_THRESHOLD, CRITICAL_ROW_FIELDS, CRITICAL_TRACE_FIELDS, ROW_COUNT_FIELD, STUDY

EXTRACTION = ["project_id", "extraction_id"]
#: A coding whose cells are given as expressions: its rows, and the cell of each compared field.
Values = dict[str, Column]


def critical_cells(rows: DataFrame, row_fields: list[str] | None = None, trace_fields: list[str] | None = None, proofs: bool = False, values: Values | None = None) -> DataFrame:
    """The compared fields of each row, in the order of their names; a field the coding lacks is a missing value.

    All cells of a row are one record of ``kinds``, ``nums`` and ``strs``: no names and no structs travel. ``values`` gives the
    cells of fields from other columns of the rows, so that no map and no record is built for them; without, they are taken
    from ``fila`` and ``traz``. ``proofs`` adds the evidence of the row, by column.
    """
    row_fields, trace_fields = _fields(row_fields, trace_fields)
    known = values or {}

    def own(key: str, place: Column) -> Column:
        return F.col(f"`v:{key}`") if f"v:{key}" in rows.columns else place

    cells = [known[k] if k in known else own(k, F.col("fila")[k]) for k in row_fields]
    cells += [known[k] if k in known else text_cell(F.col(f"traz.{k}")) for k in trace_fields]
    # the function of arrays makes Spark compile the projection in pieces: one method for all fields is too long for the JIT
    packed = F.struct(
        F.transform(F.array(*(c["kind"] for c in cells)), lambda k: F.coalesce(k, F.lit("null"))).alias("kinds"),
        F.array(*(c["num"] for c in cells)).alias("nums"), F.array(*(c["str"] for c in cells)).alias("strs"))
    study = F.coalesce(known[STUDY] if STUDY in known else own(STUDY, F.col("fila")[STUDY]), null_cell().cast(CELL_TYPE))
    given = [(F.col("evidencia") if "evidencia" in rows.columns else F.col("traz.evidencia")).alias("proofs")] if proofs else []
    return rows.select(*EXTRACTION, "row_pos", study.alias("study"), packed.alias("cells"), *given)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two codings at each place, as the lists ``_as`` and ``_bs``: rows of a place taken twice pair as in a join.

    Codings dealt by extraction, as numbered ones are, are grouped where they lie; a join by extraction and row would deal out
    all their cells anew. Places without a key pair nothing, but are counted.
    """
    place = [*EXTRACTION, "row_pos"]
    sides = a.withColumn("_b", F.lit(None).cast(b.schema["_b"].dataType)).unionByName(b.withColumn("_a", F.lit(None).cast(a.schema["_a"].dataType)))
    lists = sides.groupBy(*place).agg(F.collect_list("_a").alias("_as"), F.collect_list("_b").alias("_bs"))
    return lists.withColumn("_keyed", F.col("project_id").isNotNull() & F.col("extraction_id").isNotNull() & F.col("row_pos").isNotNull())


def _fields(row_fields: list[str] | None, trace_fields: list[str] | None) -> tuple[list[str], list[str]]:
    return CRITICAL_ROW_FIELDS if row_fields is None else row_fields, CRITICAL_TRACE_FIELDS if trace_fields is None else trace_fields


def _paired() -> Column:
    """The cells of ``_a`` and ``_b`` side by side: ka, na, sa, kb, nb, sb."""
    return F.arrays_zip(*(F.col(f"_{side}.{part}").alias(f"{part[0]}{side}") for side in "ab" for part in ("kinds", "nums", "strs")))


def _side(pair: Column, side: str) -> dict[str, Column]:
    return {"kind": pair[f"k{side}"], "num": pair[f"n{side}"], "str": pair[f"s{side}"]}


def _at(side: str, i: Column) -> dict[str, Column]:
    return {name[:-1]: F.get(F.col(f"_{side}.{name}"), i) for name in ("kinds", "nums", "strs")}


def compare_codings(a: DataFrame, b: DataFrame, row_fields: list[str] | None = None, trace_fields: list[str] | None = None, proofs: bool = False,
                    values: Values | None = None) -> DataFrame:
    """Row i against row i; rows beyond the shorter coding show only in the row count, which is a field too.

    The fields of a row travel as one record and the comparison is narrow. ``proofs`` adds the evidence ``b`` gives for a
    field that differs, as JSON.
    """
    names = F.array(*(F.lit(k) for fields in _fields(row_fields, trace_fields) for k in fields))
    ca = critical_cells(a, row_fields, trace_fields, values=values).withColumn("_a", F.struct("study", "cells"))
    cb = critical_cells(b, row_fields, trace_fields, proofs, values).withColumn("_b", F.struct("cells", *(["proofs"] if proofs else [])))
    place = [*EXTRACTION, "row_pos"]
    lists = _side_by_side(ca.select(*place, "_a"), cb.select(*place, "_b")).filter("_keyed and size(_as) > 0 and size(_bs) > 0")
    rows = lists.select(*place, F.explode("_as").alias("_a"), "_bs").select(*place, "_a", F.explode("_bs").alias("_b")).select(
        *place, F.col("_a.study").alias("_study"), F.col("_a.cells").alias("_a"), F.col("_b.cells").alias("_b"), *(["_b.proofs"] if proofs else []))
    x, y = _side(F.col("p"), "a"), _side(F.col("p"), "b")
    field = F.get(names, F.col("_i"))
    pairs = (
        rows.select(*place, cell_json(F.col("_study")).alias("study"), *(["proofs"] if proofs else []), F.posexplode(_paired()).alias("_i", "p"))
        .select(
            *place, "study", field.alias("field"),
            json_value_text(x["kind"], x["num"], x["str"]).alias("a"), json_value_text(y["kind"], y["num"], y["str"]).alias("b"),
            cells_equal(x, y).alias("equal"), *([F.when(~cells_equal(x, y), F.to_json(F.col("proofs")[field])).alias("proof")] if proofs else []),
        )
    )
    counts = row_counts(a, b)
    return pairs.unionByName(counts.withColumn("proof", F.lit(None).cast("string")) if proofs else counts)


def row_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """The number of rows of each coding as one compared field."""
    na = a.groupBy(*EXTRACTION).agg(F.count("*").alias("_na"))
    nb = b.groupBy(*EXTRACTION).agg(F.count("*").alias("_nb"))
    both = na.join(nb, EXTRACTION, "full_outer")
    x, y = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))
    return both.select(
        *EXTRACTION, F.lit(None).cast("int").alias("row_pos"), F.lit(None).cast("string").alias("study"),
        F.lit(ROW_COUNT_FIELD).alias("field"), x.cast("string").alias("a"), y.cast("string").alias("b"), (x == y).alias("equal"),
    )


def agreement(compared: DataFrame) -> DataFrame:
    """Share of equal fields per extraction, three decimals."""
    return (
        compared.groupBy(*EXTRACTION)
        .agg(F.count("*").alias("total"), F.count_if("equal").alias("hits"))
        .withColumn("agreement", F.bround(F.col("hits") / F.col("total"), 3))
    )


def agreement_of(a: DataFrame, b: DataFrame, row_fields: list[str] | None = None, trace_fields: list[str] | None = None, values: Values | None = None) -> DataFrame:
    """Agreement of two codings without a row per field: equal fields are counted inside the paired row, both row counts
    come from the same lists, and one aggregate follows."""
    place = [*EXTRACTION, "row_pos"]
    ca = critical_cells(a, row_fields, trace_fields, values=values).select(*place, F.col("cells").alias("_a"))
    cb = critical_cells(b, row_fields, trace_fields, values=values).select(*place, F.col("cells").alias("_b"))
    lists = _side_by_side(ca, cb)
    none = F.array().cast(lists.schema["_as"].dataType)
    rows = lists.select(*EXTRACTION, F.size("_as").alias("_n"), F.posexplode_outer("_as").alias("_i", "_a"), F.when(F.col("_keyed"), F.col("_bs")).otherwise(none).alias("_bs"), F.size("_bs").alias("_m"))
    rows = rows.select(*EXTRACTION, "_n", "_m", "_i", "_a", F.posexplode_outer("_bs").alias("_j", "_b"))
    first = (F.coalesce("_i", F.lit(0)) == 0) & (F.coalesce("_j", F.lit(0)) == 0)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = F.filter("_a.kinds", lambda _, i: F.coalesce(cells_equal(_at("a", i), _at("b", i)), F.lit(False)))
    equal = F.when(both, F.size(same)).otherwise(0)
    sums = rows.groupBy(*EXTRACTION).agg(
        F.sum(F.when(both, F.size("_a.nums")).otherwise(0)).alias("_fields"), F.sum(equal).alias("_equal"),
        F.sum(F.when(first, F.col("_n")).otherwise(0)).alias("_na"), F.sum(F.when(first, F.col("_m")).otherwise(0)).alias("_nb"))
    hits = F.col("_equal") + F.when(F.col("_na") == F.col("_nb"), 1).otherwise(0)
    return sums.select(*EXTRACTION, (F.col("_fields") + 1).alias("total"), hits.alias("hits"), F.bround(hits / (F.col("_fields") + 1), 3).alias("agreement"))


def low_agreement(agreements: DataFrame, threshold: float = AGREEMENT_THRESHOLD) -> DataFrame:
    """Extractions under the threshold with the notice they carry into the matrix."""
    return agreements.filter(F.col("agreement") < threshold).withColumn(
        "notice",
        F.format_string("Acuerdo extractor-codificador ciego de %s en campos críticos, menor que %s",
                        two_decimals(F.col("agreement")), F.lit(f"{threshold:.2f}")),
    )


def two_decimals(c: Column) -> Column:
    """Half-even on the exact binary value, as the notices show it."""
    return F.bround(c, 2).cast("decimal(10,2)").cast("string")


def gold_comparison(coding: DataFrame, gold: DataFrame, values: Values | None = None) -> DataFrame:
    """Agreement of a coding with a verified example."""
    return agreement_of(coding, gold, values=values)


def congruence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two matrices aligned by row and column position, each pair classed.

    ``a``, ``b``: doc_id, row_no, position, value (text). Names are not used: headers repeat.
    """
    key = ["doc_id", "row_no", "position"]
    both = a.select(*key, F.col("value").alias("_a")).join(b.select(*key, F.col("value").alias("_b")), key, "full_outer")
    empty_a, empty_b = _missing(F.col("_a")), _missing(F.col("_b"))
    kind = (
        F.when(F.col("_a").eqNullSafe(F.col("_b")) | (empty_a & empty_b), "identical")
        .when(empty_a, "missing in a").when(empty_b, "missing in b")
        .when(loose_form(F.col("_a")) == loose_form(F.col("_b")), "equivalent").otherwise("different")
    )
    return both.select(*key, kind.alias("class"))


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("", "No indica")


def loose_form(c: Column) -> Column:
    """Case, accents and the decimal mark do not count."""
    plain = F.translate(norm(c), "áéíóúàèìòùâêîôûäëïöüñç", "aeiouaeiouaeiouaeiounc")
    comma_to_point = F.regexp_replace(plain, r"(\d),(\d)", "$1.$2")
    number = comma_to_point.try_cast("double")
    return F.coalesce(number.cast("string"), comma_to_point)


def congruence_report(classes: DataFrame, label: str = "class") -> DataFrame:
    """Counts per class overall, per document and per column position, in one pass."""
    counted = classes.groupingSets(
        [[F.col(label)], [F.col("doc_id"), F.col(label)], [F.col("position"), F.col(label)]], F.col("doc_id"), F.col("position"), F.col(label)
    ).agg(F.count("*").alias("n"), F.grouping("doc_id").alias("_gd"), F.grouping("position").alias("_gp"))
    scope = F.when(F.col("_gd") == 0, "document").when(F.col("_gp") == 0, "column").otherwise("all")
    return counted.select(scope.alias("scope"), "doc_id", "position", label, "n")


def shares(report: DataFrame, label: str = "class") -> DataFrame:
    """Percentage of each class inside its scope."""
    totals = report.groupBy("scope", "doc_id", "position").agg(F.sum("n").alias("_total"))
    same = (
        (F.col("r.scope") == F.col("t.scope"))
        & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.position").eqNullSafe(F.col("t.position"))
    )
    return report.alias("r").join(totals.alias("t"), same).select(
        "r.scope", "r.doc_id", "r.position", f"r.{label}", "r.n", F.bround(100.0 * F.col("r.n") / F.col("t._total"), 1).alias("pct"))
