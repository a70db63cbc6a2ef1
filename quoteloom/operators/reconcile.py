"""Findings, decision points, decisions and the gate that accepts or drops a reconciled coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import as_col
from quoteloom.functions.typed import cell_json, cell_text
from quoteloom.operators.anchoring import anchor
from quoteloom.schemas import CELL, EVIDENCE, TRACE_FIELDS
from quoteloom.operators.matrix import whole_number
from quoteloom.vocab import (
    AGREEMENT_THRESHOLD, AUDITOR_LABELS, COMPLEX_DESIGN_PATTERN, CRITICAL_ROW_FIELDS, CRITICAL_TRACE_FIELDS, LIGHT_MAX_CHARS,
    LIGHT_MAX_TABLES, ROW_COUNT_FIELD, STUDY,
)

EXT = ["project_id", "extraction_id"]
CANNOT_CHANGE_ROWS = "El conciliador no puede abrir ni cerrar filas"
NO_VALUE = "La decisión no trae valor"
NO_QUOTE = "La cita del conciliador no se encontró en el artículo"


# ------------------------------------------------------------------ findings
def verdict(c: Column | str) -> Column:
    """Verdict written by an auditor, in any case and with spaces or underscores."""
    t = F.replace(F.upper(F.trim(F.coalesce(as_col(c), F.lit("")))), F.lit(" "), F.lit("_"))
    out = F.when(F.startswith(t, F.lit("REFUTADO")), "REFUTADO")
    for v in ("NO_VERIFICABLE", "CONFIRMADO"):
        out = out.when(F.startswith(t, F.lit(v)), v)
    return out.otherwise("NO_VERIFICABLE")


def auditor_findings(raw: DataFrame) -> DataFrame:
    """Findings of the evidence auditor without the confirmed ones.

    ``raw``: project_id, extraction_id, item_no, study, column, verdict, finding, evidence.
    """
    return raw.withColumn("verdict", verdict("verdict")).filter("verdict <> 'CONFIRMADO'").select(
        *EXT, F.format_string("A|%s", "item_no").alias("finding_id"), F.lit(None).cast("int").alias("row_pos"),
        F.col("study").try_cast("bigint").alias("study"), F.coalesce("column", F.lit(STUDY)).alias("column"),
        F.lit("AUDITOR_EVIDENCIA").alias("auditor"), "verdict", F.coalesce("finding", F.lit("")).alias("detail"),
        F.col("evidence").cast("string").alias("proposed"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"),
        F.lit(None).cast("string").alias("resolution"), F.lit("PENDIENTE").alias("state"),
    )


def blind_findings(compared: DataFrame, blind_rows: DataFrame) -> DataFrame:
    """Differences with the blind coding as refuting findings, with the blind coder's evidence.

    Where the comparison has brought that evidence (``proof``), the blind rows are not read again.
    """
    differing = compared.filter("not equal")
    proof = F.col("proof")
    if "proof" not in compared.columns:
        evidence = blind_rows.select(*EXT, "row_pos", F.col("traz.evidencia").alias("_ev"))
        differing, proof = differing.join(evidence, [*EXT, "row_pos"], "left"), F.to_json(F.col("_ev")[F.col("field")])
    detail = F.concat(F.lit("Extractor: "), F.col("a"), F.lit("; codificador ciego: "), F.col("b"))
    return differing.select(
        *EXT, F.format_string("B|%s|%s", F.coalesce(F.col("row_pos").cast("string"), F.lit("")), F.col("field")).alias("finding_id"),
        "row_pos", F.translate("study", '"', "").try_cast("bigint").alias("study"), F.col("field").alias("column"),
        F.lit("CODIFICADOR_CIEGO").alias("auditor"), F.lit("REFUTADO").alias("verdict"), detail.alias("detail"),
        proof.alias("proposed"), "a", "b",
        F.lit(None).cast("string").alias("resolution"), F.lit("PENDIENTE").alias("state"),
    )


def findings_table(raw_audit: DataFrame, compared: DataFrame, blind_rows: DataFrame) -> DataFrame:
    return auditor_findings(raw_audit).unionByName(blind_findings(compared, blind_rows))


# ------------------------------------------------------------------ decision points
def decision_points(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Blind differences and refuted audit findings, each with its row and both values.

    The row of an audit finding is the first with its study, or the only row of the extraction.
    """
    located = rows.groupBy(*EXT, whole_number(F.col("fila")[STUDY]).alias("study")).agg(F.min("row_pos").alias("_by_study"))
    only = rows.groupBy(*EXT).agg(F.count("*").alias("_n"), F.min("row_pos").alias("_first")).filter("_n = 1").select(*EXT, F.col("_first").alias("_only"))
    refuted = findings.filter("auditor = 'CODIFICADOR_CIEGO' or verdict = 'REFUTADO'")
    blind = F.col("auditor") == "CODIFICADOR_CIEGO"
    placed = (
        refuted.join(located, [*EXT, "study"], "left").join(only, EXT, "left")
        .withColumn("row_pos", F.when(blind, F.col("row_pos")).otherwise(F.coalesce("_by_study", "_only")))
        .drop("_by_study", "_only")
    )
    values = rows.select(*EXT, "row_pos", "doc_id", "fila", F.to_json("traz").alias("_traz"))
    joined = placed.join(values, [*EXT, "row_pos"], "left")
    in_row = F.map_contains_key("fila", F.col("column"))
    own = F.when(in_row, cell_json(F.col("fila")[F.col("column")])).otherwise(
        F.coalesce(F.call_function("get_json_object", F.col("_traz"), F.concat(F.lit("$['"), F.col("column"), F.lit("']"))), F.lit("null")))
    return joined.select(
        *EXT, "doc_id", "finding_id", "row_pos", "study", "column",
        F.when(blind, F.col("a")).when(F.col("row_pos").isNotNull(), own).otherwise("null").alias("own_value"),
        F.when(blind, F.col("b")).otherwise(F.coalesce("proposed", F.lit("null"))).alias("other_value"),
        F.when(blind, "Codificador ciego").otherwise("Auditor de evidencia").alias("source"), "detail",
    )


# ------------------------------------------------------------------ decisions
def judged_decisions(points: DataFrame, decisions: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Outcome of every decision point: kept, changed or pending, with the reason of a refusal.

    ``decisions``: project_id, extraction_id, finding_id, decision, has_value, value (typed struct), block_id,
    quote, reasoning. The quote of a change has to be found in the article.
    """
    key = [*EXT, "finding_id"]
    joined = points.join(decisions, key, "left").withColumn("_type", F.upper(F.coalesce("decision", F.lit("PENDIENTE"))))
    known = rows.select(*EXT, "row_pos", F.map_keys("fila").alias("_keys"))
    joined = joined.join(known, [*EXT, "row_pos"], "left")
    change = F.col("_type").isin("VALOR_ALTERNATIVO", "OTRO")
    trace = list(TRACE_FIELDS)
    refusal = (
        F.when((F.col("column") == ROW_COUNT_FIELD) | F.col("_keys").isNull(), CANNOT_CHANGE_ROWS)
        .when(~F.coalesce("has_value", F.lit(False)), NO_VALUE)
        .when(~F.array_contains("_keys", F.col("column")) & ~F.col("column").isin(trace), F.concat(F.lit("Campo desconocido: "), F.col("column")))
    )
    checked = joined.withColumn("_refusal", F.when(change, refusal))
    asked = checked.filter(change & F.col("_refusal").isNull()).select(
        *EXT, "doc_id", F.coalesce("row_pos", F.lit(0)).alias("row_pos"), F.coalesce("study", F.lit(0)).alias("study"),
        F.col("finding_id").alias("column"), F.lit(0).alias("ev_idx"), F.lit(None).cast("int").alias("page_hint"), "quote",
        F.lit(None).cast("string").alias("table_row"), F.lit(None).cast("string").alias("table_col"), F.lit(False).alias("figure"), "block_id",
    )
    anchors = anchor(asked, blocks).select(*EXT, F.col("column").alias("finding_id"), F.col("level").alias("_level"), F.col("page").alias("_page"))
    done = checked.join(anchors, key, "left")
    reason = F.coalesce("_refusal", F.when(F.col("_level") == "NO_VERIFICABLE", NO_QUOTE))
    outcome = (
        F.when(F.col("_type") == "VALOR_EXTRACTOR", "kept")
        .when(change & reason.isNull() & F.col("_level").isNotNull(), "changed").otherwise("pending")
    )
    evidence = F.struct(
        F.col("_page").alias("pagina_pdf"), F.lit("Conciliación").alias("ubicacion"), F.lit(None).cast("string").alias("fila_tabla"),
        F.lit(None).cast("string").alias("columna_tabla"), F.coalesce("quote", F.lit("")).alias("cita_textual"), F.lit(False).alias("leido_de_figura"),
        F.col("block_id").alias("bloque_id"))
    return done.select(
        *key, "doc_id", "row_pos", "study", "column", outcome.alias("outcome"), F.when(change, reason).alias("refusal"), "value", "block_id",
        F.coalesce("reasoning", F.lit("")).alias("reasoning"), evidence.cast(EVIDENCE).alias("evidence"),
    )


def apply_decisions(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows with the accepted changes; the evidence of a changed column becomes that of the decision.

    Of several changes to a cell that of the finding with the largest number stands.
    """
    latest = (
        judged.filter("outcome = 'changed'").groupBy(*EXT, "row_pos", "column")
        .agg(F.max_by(F.struct("value", "evidence"), F.struct(F.regexp_extract("finding_id", r"(\d+)$", 1).try_cast("decimal(38,0)"), F.col("finding_id"))).alias("_c"))
    )
    per_row = latest.groupBy(*EXT, "row_pos").agg(F.map_from_entries(F.collect_list(F.struct("column", "_c"))).alias("_changes"))
    joined = rows.join(per_row, [*EXT, "row_pos"], "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<struct<value: {CELL}, evidence: {EVIDENCE}>>"))
    joined = joined.withColumn("_changes", F.coalesce("_changes", none))
    changed = F.map_filter("_changes", lambda k, _: F.map_contains_key("fila", k))
    kept = F.map_filter(F.coalesce("traz.evidencia", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<array<{EVIDENCE}>>"))),
                        lambda k, _: ~F.map_contains_key(changed, k))
    fila = F.transform_values("fila", lambda k, v: F.when(F.map_contains_key("_changes", k), F.col("_changes")[k]["value"]).otherwise(v))
    traz = F.col("traz").withField("evidencia", F.map_concat(kept, F.transform_values(changed, lambda _, c: F.array(c["evidence"]))))
    for name, kind in TRACE_FIELDS.items():
        if kind in ("STRING", "DOUBLE", "BOOLEAN"):
            given = F.col("_changes")[name]["value"]
            new = {"STRING": cell_text(given), "DOUBLE": given["num"], "BOOLEAN": given["str"].try_cast("boolean")}[kind]
            swap = F.map_contains_key("_changes", name) & ~F.map_contains_key("fila", name)
            traz = traz.withField(name, F.when(swap, new).otherwise(F.col(f"traz.{name}")))
    return joined.withColumns({"fila": fila, "traz": traz}).drop("_changes")


def settled_findings(findings: DataFrame, judged: DataFrame, applied: DataFrame) -> DataFrame:
    """Findings after reconciliation. ``applied``: project_id, extraction_id, applied (whether changes stood)."""
    key = [*EXT, "finding_id"]
    d = judged.select(*key, "outcome", "refusal", "reasoning", F.col("value").alias("_value"), F.col("block_id").alias("_block"))
    joined = findings.join(d, key, "left").join(applied, EXT, "left").withColumn("_ok", F.coalesce("applied", F.lit(False)))
    told = F.concat(cell_json(F.col("_value")), F.lit(" ("), F.coalesce("_block", F.lit("None")), F.lit("). "), F.col("reasoning"))
    resolution = (
        F.when(F.col("outcome") == "kept", F.trim(F.concat(F.lit("Conciliador: se mantiene el valor del extractor. "), F.col("reasoning"))))
        .when((F.col("outcome") == "changed") & F.col("_ok"), F.trim(F.concat(F.lit("Conciliador: "), told)))
    )
    settled = joined.withColumns({
        "resolution": F.coalesce(resolution, F.col("resolution")),
        "state": F.when(resolution.isNotNull(), "RESUELTO").otherwise(F.col("state")),
    })
    refused_text = F.concat(F.lit("El cambio del conciliador no pasó el validador; propuesta: "), cell_json(F.col("_value")), F.lit(". "), F.col("reasoning"))
    pending_text = F.trim(F.concat(F.lit("PENDIENTE para el responsable del dominio. "),
                                   F.when(F.col("refusal").isNotNull(), F.concat(F.col("refusal"), F.lit(". "))).otherwise(""), F.col("reasoning")))
    added = joined.filter("outcome = 'pending' or (outcome = 'changed' and not _ok)").withColumns({
        "detail": F.when(F.col("outcome") == "changed", refused_text).otherwise(pending_text),
        "finding_id": F.concat(F.lit("C|"), F.col("finding_id")),
        "auditor": F.lit("CONCILIADOR"), "verdict": F.lit("NO_VERIFICABLE"), "state": F.lit("PENDIENTE"),
        "proposed": F.lit(None).cast("string"), "resolution": F.lit(None).cast("string"),
    })
    names = findings.columns
    return settled.select(*names).unionByName(added.select(*names))


def gate(old_rows: DataFrame, new_rows: DataFrame, judged: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All or nothing per extraction: the new rows stand only if re-validation found no error.

    Returns the rows to keep and, per extraction with changes, whether they were applied.
    """
    changed = judged.filter("outcome = 'changed'").select(*EXT).distinct()
    errors = violations.filter("severity = 'E'").select(*EXT).distinct()
    verdicts = changed.join(errors.withColumn("_bad", F.lit(True)), EXT, "left").select(*EXT, F.col("_bad").isNull().alias("applied"))
    good = verdicts.filter("applied").select(*EXT)
    rows = new_rows.join(good, EXT, "left_semi").unionByName(old_rows.join(good, EXT, "left_anti"))
    return rows, verdicts


# ------------------------------------------------------------------ attempts, routing, escalation
def attempt_status(attempts: DataFrame, limit: int = 3, shown: int | None = None) -> DataFrame:
    """Iterations and state of each extraction from its validator runs; ``attempts``: iteration, errors (array)."""
    last = attempts.groupBy(*EXT).agg(F.max("iteration").alias("iterations"), F.max_by("errors", "iteration").alias("last_errors"))
    n = F.size("last_errors")
    return last.select(
        *EXT, "iterations", n.alias("errors"),
        F.when(n == 0, "valid").when(F.col("iterations") >= limit, "FALLIDA").otherwise("retry").alias("status"),
        F.array_join(F.col("last_errors") if shown is None else F.slice("last_errors", 1, shown), " | ").alias("first_errors"),
    )


def route_blind_coder(blocks: DataFrame, lines: DataFrame, light_chars: int = LIGHT_MAX_CHARS, light_tables: int = LIGHT_MAX_TABLES) -> DataFrame:
    """Model level for the blind coder by signs of complexity, first that applies.

    Text length and design terms are reduced per line, so no document text is put together.
    """
    doc = ["project_id", "doc_id"]
    shape = blocks.groupBy(*doc).agg(F.count_if("is_image").alias("_images"), F.count_if("is_table").alias("_tables"))
    term = F.nullif(F.regexp_extract("line", f"({COMPLEX_DESIGN_PATTERN})", 1), F.lit(""))
    body = lines.withColumn("_term", term).groupBy(*doc).agg(
        (F.sum(F.char_length("line")) + F.count("*") - 1).alias("chars"),
        F.min_by("_term", F.when(F.col("_term").isNotNull(), F.struct("pos", "sub"))).alias("_term"),
    )
    joined = shape.join(body, doc, "left")
    reason = (
        F.when(F.col("_images") > 0, "tablas o figuras en imagen")
        .when(F.col("chars") > light_chars, "artículo largo")
        .when(F.col("_tables") > light_tables, f"más de {light_tables} tablas")
        .when(F.col("_term").isNotNull(), F.concat(F.lit("diseño complejo ('"), F.col("_term"), F.lit("')")))
        .otherwise("artículo sin señales de complejidad")
    )
    out = joined.withColumn("reason", reason)
    light = F.col("reason") == "artículo sin señales de complejidad"
    return out.select(*doc, F.when(light, "ligero").otherwise("especializado").alias("level"), "reason")


def escalate(light: DataFrame, specialised: DataFrame, agreements: DataFrame, threshold: float = AGREEMENT_THRESHOLD) -> DataFrame:
    """Blind coding to use per extraction: the light one unless unreadable or in low agreement.

    ``agreements``: agreement of the extraction with its light coding; no row means it could not be read.
    """
    good = agreements.filter(F.col("agreement") >= threshold).select(*EXT)
    return (
        light.join(good, EXT, "left_semi").withColumn("coder_level", F.lit("ligero"))
        .unionByName(specialised.join(good, EXT, "left_anti").withColumn("coder_level", F.lit("especializado")))
    )


# ------------------------------------------------------------------ renderings
def audit_rows(findings: DataFrame) -> DataFrame:
    """Findings in the wording of the audit sheet."""
    labels = F.create_map(*[F.lit(x) for pair in AUDITOR_LABELS.items() for x in pair])
    return findings.select(
        *EXT, "study", "column", F.try_element_at(labels, F.col("auditor")).alias("auditor"),
        F.replace(F.col("verdict"), F.lit("_"), F.lit(" ")).alias("verdict"), F.col("detail").alias("finding"), "resolution",
        F.when(F.col("state") == "RESUELTO", "Resuelto").otherwise("Pendiente").alias("state"),
    )


def extraction_summary(extractions: DataFrame, rows: DataFrame, anchors: DataFrame, agreements: DataFrame, findings: DataFrame,
                       violations: DataFrame, usage: DataFrame) -> DataFrame:
    """One line per extraction: state, studies, agreement, levels, pending findings, errors and cost."""
    from quoteloom.operators.anchoring import level_summary

    studies = rows.groupBy(*EXT).agg(F.array_sort(F.collect_set(whole_number(F.col("fila")[STUDY]))).alias("_studies"))
    pending = findings.groupBy(*EXT).agg(F.count_if(F.col("state") == "PENDIENTE").alias("pending"))
    errors = violations.groupBy(*EXT).agg(F.count_if(F.col("severity") == "E").alias("errors"))
    cost = usage.groupBy(*EXT).agg(F.bround(F.sum("cost_usd"), 4).alias("cost_usd"))
    out = extractions.select(*EXT, "state")
    for side in (studies, level_summary(anchors, EXT), agreements.select(*EXT, "agreement"), pending, errors, cost):
        out = out.join(side, EXT, "left")
    done = F.col("state") == "COMPLETADA"
    return out.withColumn("studies", F.when(done, F.col("_studies")).otherwise(F.array().cast("array<bigint>"))).drop("_studies").na.fill(
        0, ["pending", "errors", "VERIFICADA", "VERIFICADA_CON_CORRECCION", "POR_CONFIRMAR", "NO_VERIFICABLE"]).na.fill(0.0, ["cost_usd"])
