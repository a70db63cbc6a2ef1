"""Tables of an export: sheet rows, traceability, audit, cell comments, fills, and the round-trip check."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.typed import cell_json, cell_text, is_null
from quoteloom.operators.ordering import running_sum
from quoteloom.operators.spread import spread_join
from quoteloom.session import cut_lineage
from quoteloom.vocab import MISSING_CODES, STUDY

ROW = ["project_id", "extraction_id", "row_pos"]
#: Rows that the file format of a sheet holds.
SHEET_ROWS = 1 << 20


# ------------------------------------------------------------------ places in the sheet
def _filled(origins: list[int | None]) -> list[int]:
    """Sheet rows of one project, given the original rows by study, seen from the sheet: each row number from 2 goes to the
    earliest study that waits for it.

    Studies without a row of their own, or whose row an earlier study names too, wait from the start; every other one begins to
    wait at its own row. A study that gets a row it did not name leaves that row's owner waiting for a later one.
    """
    owner: dict[int, int] = {}
    waiting = [i for i, origin in enumerate(origins) if origin is None or owner.setdefault(origin, i) != i]
    rows = [origin if origin is not None else 0 for origin in origins]
    row = 2
    for nxt in [*sorted(r for r in owner if r >= 2), None]:
        while waiting and (nxt is None or row < nxt):
            rows[heapq.heappop(waiting)] = row
            row += 1
        if nxt is not None:
            rows[heapq.heappushpop(waiting, owner[nxt])] = nxt
            row = nxt + 1
    return rows


def _fill_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places rows that come by project and study. A project may run over several batches; many fit one."""
    project, studies, origins = None, [], []
    done: tuple[list, list, list, list] = ([], [], [], [])

    def close() -> None:
        for column, values in zip(done, ([project] * len(studies), studies, origins, _filled(origins))):
            column.extend(values)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(done)], ["project_id", "study", "origin_row", "sheet_row"])
        for column in done:
            column.clear()
        return out

    for batch in batches:
        for p, study, origin in zip(*(c.to_pylist() for c in batch.columns)):
            if p != project and studies:
                close()
                studies, origins = [], []
            project = p
            studies.append(study)
            origins.append(origin)
            if len(studies) >= SHEET_ROWS:
                raise ValueError(f"project {project}: {SHEET_ROWS} rows or more do not fit a sheet")
        yield flush()
    if studies:
        close()
        yield flush()


def place_inherited(rows: DataFrame) -> DataFrame:
    """Sheet row of each inherited row: its original one, or the next free from 2 when missing or taken, by study.

    Projects whose original rows are all present and distinct are placed by projection. The others are ordered in one task
    each: two numbers per row, and no more rows than a sheet's file format holds, which is checked. A task takes its projects
    one after the other from sorted rows, so a call to Python serves many small ones.
    """
    narrow = rows.select("project_id", "study", F.col("origin_row").cast("bigint").alias("origin_row"))
    slots = narrow.groupBy("project_id", "origin_row").agg(F.count("*").alias("_n"))
    clash = slots.filter("_n > 1 or origin_row is null").select("project_id").distinct()
    simple = narrow.join(clash, "project_id", "left_anti").withColumn("sheet_row", F.col("origin_row"))
    waiting = narrow.join(clash, "project_id", "left_semi").select(F.col("project_id").cast("string").alias("project_id"), F.col("study").cast("bigint").alias("study"), "origin_row")
    ordered = waiting.repartition("project_id").sortWithinPartitions("project_id", F.asc_nulls_last("study"), F.asc_nulls_last("origin_row"))
    hard = ordered.mapInArrow(_fill_in_order, "project_id string, study bigint, origin_row bigint, sheet_row bigint")
    return simple.unionByName(hard)


def place_extracted(studies: DataFrame, sheet: DataFrame) -> DataFrame:
    """Sheet row of each extracted study: that of the equal study, else after the last used row, in batch order.

    ``studies``: project_id, study, batch_no. ``sheet``: project_id, study, sheet_row.
    """
    firsts = studies.groupBy("project_id", "study").agg(F.min("batch_no").alias("batch_no"))
    known = sheet.groupBy("project_id", "study").agg(F.max("sheet_row").alias("_known"))
    last = sheet.groupBy("project_id").agg(F.max("sheet_row").alias("_last"))
    joined = firsts.join(known, ["project_id", "study"], "left").join(last, "project_id", "left")
    numbered = running_sum(joined, ["project_id"], "batch_no", F.when(F.col("_known").isNull(), 1).otherwise(0), "_n")
    return numbered.select("project_id", "study", F.coalesce("_known", F.coalesce("_last", F.lit(1)) + F.col("_n")).alias("sheet_row"))


# ------------------------------------------------------------------ traceability and audit
def _inferred_keys() -> Column:
    cut = F.transform("traz.inferencias", lambda x: F.get(F.split(x["columna"], r" \("), F.lit(0)))
    return F.coalesce(cut, F.array().cast("array<string>"))


def traceability(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Long traceability table: values with their evidence, inferences, discrepancies, warnings and a summary.

    (section, position, idx) give the order inside a study.
    """
    study = cell_text(F.col("fila")[STUDY])
    base = rows.withColumn("study", study).withColumn("_inferred", _inferred_keys())
    cols = columns.select("project_id", "key", "position")
    cells = base.join(cols, "project_id").withColumn("_v", F.col("fila")[F.col("key")])
    kind = (
        F.when(is_null(F.col("_v")) | F.coalesce(F.col("_v.str").isin(MISSING_CODES), F.lit(False)), "Faltante")
        .when(F.array_contains("_inferred", F.col("key")), "Inferido").otherwise("Literal o codificado")
    )
    shown = F.when(F.col("_v.kind").isin("int", "float", "str"), cell_text(F.col("_v"))).otherwise(cell_json(F.col("_v")))
    evidence = F.col("traz.evidencia")[F.col("key")]
    some = F.when(F.size(evidence) > 0, evidence)
    values = cells.select(
        *ROW, "study", F.lit(1).alias("section"), "position", F.col("key").alias("column"), shown.alias("value"), kind.alias("kind"),
        F.when(is_null(F.col("_v")), F.col("traz.estado_del_dato")[F.col("key")]).alias("note"), F.posexplode_outer(some).alias("idx", "_e"),
    ).select(
        *ROW, "study", "section", "position", F.coalesce("idx", F.lit(0)).alias("idx"), "column", "value", F.col("_e.pagina_pdf").alias("page"),
        F.col("_e.ubicacion").alias("location"), F.col("_e.fila_tabla").alias("table_row"), F.col("_e.columna_tabla").alias("table_col"),
        F.col("_e.cita_textual").alias("quote"), F.col("_e.leido_de_figura").alias("figure"), "kind", "note",
    )

    def extra(section: int, items: str, column: Column, value: Column, label: str, note: Column) -> DataFrame:
        exploded = base.select(*ROW, "study", F.posexplode(items).alias("idx", "_x"))
        return exploded.select(
            *ROW, "study", F.lit(section).alias("section"), F.lit(0).alias("position"), "idx", column.alias("column"), value.alias("value"),
            F.lit(label).alias("kind"), note.alias("note"))

    x = F.col("_x")
    inferences = extra(2, "traz.inferencias", x["columna"], x["valor"], "Inferencia", F.concat(x["regla_aplicada"], F.lit(": "), x["razonamiento"]))
    discrepancies = extra(3, "traz.discrepancias_en_el_articulo", x["columna"], x["valor_adoptado"], "Discrepancia del artículo",
                          F.concat(x["fuente_1"], F.lit(" || "), x["fuente_2"]))
    warnings = extra(4, "traz.advertencias_pendientes", F.lit(None).cast("string"), F.lit(None).cast("string"), "Advertencia", x)
    summary = base.select(
        *ROW, "study", F.lit(5).alias("section"), F.lit(0).alias("position"), F.lit(0).alias("idx"), F.lit("confianza").alias("column"),
        F.col("traz.confianza").alias("value"), F.lit("Resumen").alias("kind"),
        F.format_string("extractor: %s; fecha: %s; verificador: %s", "traz.extractor", "traz.fecha_extraccion", "traz.verificador").alias("note"))
    out = values
    for frame in (inferences, discrepancies, warnings, summary):
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def audit_of_studies(audit: DataFrame, studies: DataFrame) -> DataFrame:
    """Audit rows of the exported studies."""
    return audit.join(studies.select("project_id", "study").distinct(), ["project_id", "study"], "left_semi")


# ------------------------------------------------------------------ comments and fills
def evidence_comment(evidence: Column, limit: int | None = None) -> Column:
    """Comment text of a cell from its evidence, in order; a sink that renders short comments gives a limit."""

    def one(e: Column) -> Column:
        def part(prefix: str, c: Column) -> Column:
            return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(prefix), c)).otherwise("")

        return F.concat(
            F.lit("p. "), F.coalesce(e["pagina_pdf"].cast("string"), F.lit("None")), F.lit(" | "), F.coalesce(e["ubicacion"], F.lit("None")),
            part(" | fila: ", e["fila_tabla"]), part(" | col: ", e["columna_tabla"]),
            F.when(F.coalesce(e["leido_de_figura"], F.lit(False)), " | leído de figura").otherwise(""),
            F.lit('\n"'), F.coalesce(e["cita_textual"], F.lit("")), F.lit('"'))

    text = F.array_join(F.transform(evidence, one), "\n")
    return text if limit is None else F.substring(text, 1, limit)


def cell_comments(rows: DataFrame, columns: DataFrame, comment_limit: int | None = None, note_limit: int | None = None) -> DataFrame:
    """Comment and fill inputs of each cell: evidence text, or the code of a missing value, then the reasons why.

    Reasons (inferences, then discrepancies) are appended to the comment of their own cell.
    """
    # stored, so that Spark knows how small it is: dealt by project, the wide rows would come to a few tasks
    catalogue = cut_lineage(columns.select("project_id", "key", "position"))
    # what a row says once is derived before its cells are dealt out, so that cells without comments carry no maps
    disputed = F.coalesce(F.transform("traz.discrepancias_en_el_articulo", lambda x: x["columna"]), F.array().cast("array<string>"))
    own = rows.withColumns({"_study": cell_text(F.col("fila")[STUDY]), "_inferred": _inferred_keys(), "_disputed": disputed})
    base = own.join(catalogue, "project_id")
    key = F.col("key")
    evidence = F.col("traz.evidencia")[key]
    v = F.col("fila")[key]
    comment = F.when(F.size(evidence) > 0, evidence_comment(evidence, comment_limit)).when(is_null(v), F.col("traz.estado_del_dato")[key])
    none = F.array().cast("array<string>")
    inferred = F.transform(
        F.filter("traz.inferencias", lambda x: F.get(F.split(x["columna"], r" \("), F.lit(0)) == key),
        lambda x: F.concat(F.lit("POR QUÉ (inferido, "), x["regla_aplicada"], F.lit("): "), x["razonamiento"]))
    conflicting = F.transform(
        F.filter("traz.discrepancias_en_el_articulo", lambda x: x["columna"] == key),
        lambda x: F.concat(F.lit("DISCREPANCIA DEL ARTÍCULO: "), x["fuente_1"], F.lit(" || "), x["fuente_2"], F.lit(" -> adoptado: "), x["valor_adoptado"]))
    why = F.concat(F.coalesce(inferred, none), F.coalesce(conflicting, none))
    step = base.withColumns({"_comment": comment, "_why": why})
    before = F.coalesce(F.concat(F.col("_comment"), F.lit("\n\n")), F.lit(""))
    with_why = F.concat(before, F.array_join("_why", "\n"))
    with_why = with_why if note_limit is None else F.substring(with_why, 1, note_limit)
    full = F.when(F.size("_why") > 0, with_why).otherwise(F.col("_comment"))
    return step.select(
        *ROW, F.col("_study").alias("study"), "key", "position", full.alias("comment"), F.array_contains("_inferred", key).alias("inferred"),
        F.coalesce(F.array_contains("_disputed", key), F.lit(False)).alias("discrepancy"))


def cell_fills(comments: DataFrame, audit: DataFrame) -> DataFrame:
    """Fill of each cell: pending finding before discrepancy before inferred value."""
    pending = audit.filter("state <> 'Resuelto'").select("project_id", F.col("study").cast("string").alias("study"), F.col("column").alias("key")).distinct()
    # stored, so that its size is known: few studies and columns hold many cells, which would be dealt to few tasks
    joined = spread_join(comments, cut_lineage(pending.withColumn("_pending", F.lit(True))), ["project_id", "study", "key"], ROW, "left")
    fill = F.when(F.col("_pending"), "rojo").when(F.col("discrepancy"), "naranja").when(F.col("inferred"), "amarillo")
    return joined.withColumn("fill", fill).drop("_pending")


def replace_studies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Output table with the rows of the new studies in place of theirs."""
    return old.join(new.select("project_id", "study").distinct(), ["project_id", "study"], "left_anti").unionByName(new, allowMissingColumns=True)


def round_trip_differences(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Cells whose values differ, or that exist on one side only."""
    a = before.select(*keys, F.struct(*values).alias("before"))
    b = after.select(*keys, F.struct(*values).alias("after"))
    return a.join(b, keys, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
