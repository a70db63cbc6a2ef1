"""Queries on the matrix of cells, its review and its export, from orders and coded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.typed import CELL_TYPE, cell_json, cell_text, float_cell, int_cell, text_cell
from quoteloom.operators import export, matrix, reconcile, review, rules
from quoteloom.plans.derived import CODED, FILA, coded, coded_wide, codebook_columns, numbered
from quoteloom.plans.registry import Tables, query
from quoteloom.session import cut_lineage
from quoteloom.sources import sheets

# order attributes as columns of a matrix; the status of an order gives its review state and origin
_KEYS = [("Estudio", 1, "entero"), ("Documento", 2, "entero"), ("Prioridad", 3, "texto"), ("Precio", 4, "número o null"), ("Fecha", 5, "texto")]
_ALLOWED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "Otro: (texto)"]
ORDERS = """m AS (SELECT substr(o_orderpriority, 1, 1) AS project_id, o_orderkey AS study, o_custkey AS document, o_orderkey AS row_no,
  CASE WHEN o_orderstatus = 'F' THEN 'HEREDADA' ELSE 'EXTRAIDA' END AS origin, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS STRING) END AS article_id,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'Otro: ' || o_orderstatus ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS price, substr(CAST(o_orderdate AS STRING), 1, 10) AS day, o_orderstatus AS status FROM orders)"""


def wide(t: Tables) -> DataFrame:
    return t.read("orders").selectExpr(
        "substr(o_orderpriority, 1, 1) AS project_id", "o_orderkey AS study", "o_custkey AS document", "o_orderkey AS row_no",
        "CASE WHEN o_orderstatus = 'F' THEN 'HEREDADA' ELSE 'EXTRAIDA' END AS origin",
        "CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS STRING) END AS article_id",
        "CASE WHEN o_orderpriority LIKE '5%' THEN 'Otro: ' || o_orderstatus ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS price", "substr(CAST(o_orderdate AS STRING), 1, 10) AS day", "o_orderstatus AS status")


def _values() -> dict:
    return {
        "Estudio": int_cell(F.col("study")).cast(CELL_TYPE), "Documento": int_cell(F.col("document")).cast(CELL_TYPE),
        "Prioridad": text_cell(F.col("priority")).cast(CELL_TYPE), "Precio": float_cell(F.col("price")).cast(CELL_TYPE), "Fecha": text_cell(F.col("day")).cast(CELL_TYPE)}


def columns(t: Tables) -> DataFrame:
    specs = [F.struct(F.lit(k).alias("key"), F.lit(i).alias("position"), F.lit(d).alias("data_type"),
                      (F.array(*map(F.lit, _ALLOWED)) if k == "Prioridad" else F.lit(None).cast("array<string>")).alias("allowed"),
                      F.lit(k).alias("header"), F.lit("ABCDE"[i - 1]).alias("letter"), F.lit(k == "Precio").alias("is_numeric"), F.lit(k == "Precio").alias("needs_evidence"))
             for k, i, d in _KEYS]
    return wide(t).select("project_id").distinct().select("project_id", F.explode(F.array(*specs)).alias("c")).select("project_id", "c.*")


def cells(t: Tables) -> DataFrame:
    """Cells as the matrix keeps them."""
    long = matrix.unpivot_wide(wide(t), ["project_id", "study", "document", "origin", "article_id", "status"], _values())
    state = F.when(F.col("origin") == "HEREDADA", "SIN_EVIDENCIA").when(F.col("key") == "Fecha", "POR_CONFIRMAR").when(
        (F.col("key") == "Prioridad") & (F.col("study") % 4 == 0), "NO_VERIFICABLE").otherwise("PENDIENTE")
    place = F.create_map(*[x for k, i, _ in _KEYS for x in (F.lit(k), F.lit(i))])
    return long.withColumns({
        "position": F.try_element_at(place, F.col("key")), "review_state": state, "data_state": F.when(F.col("value.kind") == "null", "No indica"),
        "value_type": F.when(F.col("value.kind") == "null", "FALTANTE").when((F.col("key") == "Precio") & (F.col("study") % 5 == 0), "INFERIDO").otherwise("CODIFICADO"),
        "evidence_count": F.when(F.col("key") == "Precio", 1).otherwise(0),
        "inference": F.when((F.col("key") == "Precio") & (F.col("study") % 5 == 0), F.struct(F.lit("regla").alias("rule"), F.when(F.col("study") % 10 == 0, "por suma").alias("reasoning")))})


CELLS = f"""{ORDERS}, c AS (
  SELECT m.*, k.key, k.position, CASE k.key WHEN 'Estudio' THEN CAST(study AS STRING) WHEN 'Documento' THEN CAST(document AS STRING) WHEN 'Prioridad' THEN priority
      WHEN 'Precio' THEN CAST(price AS STRING) ELSE day END AS v
  FROM m, (VALUES ('Estudio', 1), ('Documento', 2), ('Prioridad', 3), ('Precio', 4), ('Fecha', 5)) k(key, position)
), cells AS (SELECT *, CASE WHEN origin = 'HEREDADA' THEN 'SIN_EVIDENCIA' WHEN key = 'Fecha' THEN 'POR_CONFIRMAR' WHEN key = 'Prioridad' AND study % 4 = 0 THEN 'NO_VERIFICABLE' ELSE 'PENDIENTE' END AS review_state,
  CASE WHEN v IS NULL THEN 'FALTANTE' WHEN key = 'Precio' AND study % 5 = 0 THEN 'INFERIDO' ELSE 'CODIFICADO' END AS value_type, CASE WHEN key = 'Precio' THEN 1 ELSE 0 END AS evidence_count FROM c)"""
_OUTSIDE = "(key = 'Prioridad' AND v IS NOT NULL AND v NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND NOT regexp_matches(v, '^Otro: \\S'))"


# ------------------------------------------------------------------ import
def _sheet(t: Tables) -> DataFrame:
    """The wide matrix as a sheet of texts, with a header and empty rows, next to a sheet with another header."""
    body = wide(t).select("project_id", F.lit("Matriz").alias("sheet"), (F.col("study") + 2).alias("row_no"), F.when(
        F.col("study") % 50 == 7, F.array(*[F.lit("")] * 5)).otherwise(F.array(F.col("study").cast("string"), F.col("document").cast("string"), "priority", F.col("price").cast("string"), "day")).alias("cells"))
    names = [k for k, _, _ in _KEYS]
    good = columns(t).select("project_id").distinct().select("project_id", F.lit("Matriz").alias("sheet"), F.lit(1).cast("bigint").alias("row_no"), F.array(*map(F.lit, names)).alias("cells"))
    other = good.select("project_id", F.lit("Apuntes").alias("sheet"), "row_no", F.array(*map(F.lit, ["Estudio", "x", "Prioridad", "y"])).alias("cells"))
    return body.unionByName(good).unionByName(other)


@query("sheet_headers", f"""WITH {ORDERS}, p AS (SELECT DISTINCT project_id FROM m) SELECT project_id, 'Apuntes' AS sheet,
  'B: se esperaba Documento y hay x; D: se esperaba Precio y hay y; E: se esperaba Fecha y hay None' AS report FROM p""")
def sheet_headers(t: Tables) -> DataFrame:
    return sheets.mismatch_report(sheets.header_differences(_sheet(t), columns(t)))


@query("sheet_cells", f"""WITH {CELLS} SELECT project_id, study + 2 AS row_no, key, CASE WHEN v IS NULL THEN 'null' WHEN key IN ('Estudio', 'Documento') THEN 'int' WHEN key = 'Precio' THEN 'float' ELSE 'str' END AS kind,
  v AS text FROM cells WHERE study % 50 <> 7""")
def sheet_cells(t: Tables) -> DataFrame:
    raw, cols = _sheet(t), columns(t)
    out = sheets.sheet_cells(raw, cols, sheets.matching_sheets(raw, cols))
    return out.select("project_id", "row_no", "key", F.col("value.kind").alias("kind"), cell_text(F.col("value")).alias("text"))


def _imported(t: Tables) -> DataFrame:
    long = matrix.unpivot_wide(wide(t), ["project_id", "row_no"], _values())
    return matrix.imported_cells(long, matrix.import_rows(long), columns(t))


@query("imported_cells", f"""WITH {CELLS} SELECT project_id, study, document, key, position, CASE WHEN v IS NULL THEN 'FALTANTE' END AS value_type, 'SIN_EVIDENCIA' AS review_state,
  coalesce({_OUTSIDE}, FALSE) AS out_of_vocabulary FROM cells""")
def imported_cells(t: Tables) -> DataFrame:
    return _imported(t).select("project_id", "study", "document", "key", "position", "value_type", "review_state", "out_of_vocabulary")


@query("import_problems", f"""WITH {ORDERS}, x AS (SELECT project_id, row_no, CASE WHEN study % 9 = 0 THEN NULL ELSE study // 2 END AS study, status FROM m),
f AS (SELECT project_id, study, min(row_no) AS first FROM x WHERE study IS NOT NULL GROUP BY ALL)
SELECT project_id, row_no, study, 'Estudio debe ser entero' AS problem FROM x WHERE study IS NULL
UNION ALL SELECT project_id, row_no, study, 'Documento debe ser entero' FROM x WHERE status = 'P'
UNION ALL SELECT x.project_id, row_no, x.study, 'Estudio repetido' FROM x JOIN f ON f.project_id = x.project_id AND f.study = x.study WHERE row_no > first""")
def import_problems(t: Tables) -> DataFrame:
    study = F.when(F.col("study") % 9 == 0, text_cell(F.lit("nueve"))).otherwise(int_cell(F.floor(F.col("study") / 2))).cast(CELL_TYPE)
    document = F.when(F.col("status") == "P", float_cell(F.lit(1.5))).otherwise(int_cell(F.col("document"))).cast(CELL_TYPE)
    long = matrix.unpivot_wide(wide(t), ["project_id", "row_no"], {"Estudio": study, "Documento": document})
    return matrix.import_problems(matrix.import_rows(long))


@query("import_summary", f"""WITH {CELLS} SELECT project_id, count(*) FILTER (key = 'Estudio') AS "rows", count(DISTINCT document) AS documents,
  count(*) FILTER ({_OUTSIDE}) AS out_of_vocabulary, count(*) FILTER (key = 'Precio' AND study % 3 = 0) AS notes FROM cells GROUP BY ALL""")
def import_summary(t: Tables) -> DataFrame:
    notes = wide(t).filter("study % 3 = 0").select("project_id", "study", F.lit("Precio").alias("key"))
    return matrix.import_summary(_imported(t), notes)


@query("import_guard", f"""WITH {ORDERS} SELECT project_id, count(*) FILTER (origin = 'HEREDADA') AS inherited, count(*) FILTER (origin = 'EXTRAIDA') AS extracted,
  CASE WHEN count(*) FILTER (origin = 'EXTRAIDA') > 0 THEN 'extracted rows exist' ELSE 'replace inherited' END AS outcome FROM m WHERE project_id <> '1' OR origin = 'HEREDADA' GROUP BY ALL""")
def import_guard(t: Tables) -> DataFrame:
    return matrix.import_guard(wide(t).filter("project_id <> '1' or origin = 'HEREDADA'"), True)


@query("without_inherited", f"""WITH {ORDERS} SELECT project_id, origin, count(*) AS n FROM m WHERE project_id <> '1' GROUP BY ALL""")
def without_inherited(t: Tables) -> DataFrame:
    rows = wide(t).filter("project_id <> '1' or origin = 'HEREDADA'")
    return matrix.without_inherited(rows, matrix.import_guard(rows, True)).groupBy("project_id", "origin").agg(F.count("*").alias("n"))


@query("vocabulary_check", f"""WITH {CELLS} SELECT project_id, key, count(*) FILTER ({_OUTSIDE}) AS outside, count(*) FILTER (NOT coalesce({_OUTSIDE}, FALSE)) AS inside FROM cells GROUP BY ALL""")
def vocabulary_check(t: Tables) -> DataFrame:
    joined = cells(t).join(columns(t).select("project_id", "key", "allowed", "data_type"), ["project_id", "key"])
    ok = rules.vocabulary_ok(F.col("value"), F.col("allowed"), F.col("data_type"))
    return joined.groupBy("project_id", "key").agg(F.count_if(~ok).alias("outside"), F.count_if(ok).alias("inside"))


# ------------------------------------------------------------------ cells of a coding
def _assembled(t: Tables) -> DataFrame:
    """Cells of all rows; anchors meet the numbered lines, before values are derived from these."""
    lines = cut_lineage(numbered(t))
    levels = F.when(F.col("row_pos") % 3 == 0, "VERIFICADA").when(F.col("row_pos") % 3 == 1, "POR_CONFIRMAR").otherwise("NO_VERIFICABLE")
    anchors = lines.select("project_id", "extraction_id", "row_pos", F.lit("Muestra").alias("column"), F.lit(0).alias("ev_idx"), levels.alias("level"), F.lit(100.0).alias("similarity"),
                           F.lit("p03-b01").alias("block_id"), F.lit(3).alias("page"))
    rows = coded_wide(t, matrix.with_anchors(lines, anchors), keep=("_anchors",))
    return matrix.assemble_cells(coded(t, rows, keep=("_anchors",)), codebook_columns(t))


_LITERALS = f"""WITH {CODED}, k AS (SELECT unnest(['Muestra', 'Correlación Feli 1 - JP', 'Nivel']) AS key), c AS (SELECT coded.*, key FROM coded, k)
SELECT project_id, extraction_id, row_pos, estudio AS study, key,
  CASE WHEN key = 'Muestra' AND muestra IS NULL THEN st_muestra WHEN key = 'Correlación Feli 1 - JP' AND r IS NULL THEN st_r END AS data_state,
  CASE WHEN key = 'Muestra' THEN CASE WHEN muestra IS NULL THEN 'FALTANTE' WHEN ev_muestra THEN 'LITERAL' ELSE 'CODIFICADO' END
    WHEN key = 'Nivel' THEN 'CODIFICADO' WHEN r IS NULL THEN 'FALTANTE' WHEN ev_r AND contains(quote_muestra, CAST(r AS STRING)) THEN 'LITERAL' ELSE 'CODIFICADO' END AS value_type,
  CASE WHEN (key = 'Muestra' AND ev_muestra) OR (key = 'Correlación Feli 1 - JP' AND ev_r) THEN 1 ELSE 0 END::BIGINT AS evidences,
  CASE WHEN key = 'Muestra' AND ev_muestra THEN ['PENDIENTE', 'POR_CONFIRMAR', 'NO_VERIFICABLE'][row_pos % 3 + 1] ELSE 'PENDIENTE' END AS review_state FROM c"""


@query("assembled_cells", _LITERALS)
def assembled_cells(t: Tables) -> DataFrame:
    wanted = _assembled(t).filter(F.col("key").isin("Muestra", "Correlación Feli 1 - JP", "Nivel"))
    return wanted.select("project_id", "extraction_id", "row_pos", "study", "key", "data_state", "value_type", F.size("evidence").alias("evidences"), "review_state")


@query("assembled_cell_counts", f"""WITH {CODED} SELECT project_id, count(*) * 29 AS cells FROM coded GROUP BY ALL""")
def assembled_cell_counts(t: Tables) -> DataFrame:
    """One cell per row and catalogue column."""
    return _assembled(t).groupBy("project_id").agg(F.count("*").alias("cells"))


@query("coverage_exceptions", f"""WITH {CELLS} SELECT project_id, document, study, key, 'value without anchor' AS problem FROM cells WHERE key = 'Precio' AND v IS NOT NULL AND value_type <> 'INFERIDO' AND study % 2 = 1
UNION ALL SELECT project_id, document, study, key, 'inference without rule or reasoning' FROM cells WHERE value_type = 'INFERIDO' AND study % 10 <> 0""")
def coverage_exceptions(t: Tables) -> DataFrame:
    anchors = wide(t).filter("study % 2 = 0").select("project_id", "study", F.lit("Precio").alias("column"))
    return rules.coverage_exceptions(cells(t), columns(t), anchors)


@query("findings_on_cells", f"""WITH {CODED}, f AS (SELECT project_id, extraction_id, CASE WHEN items1 = 4 THEN NULL ELSE estudio END AS study, CASE WHEN items1 = 3 THEN 'Rara' ELSE 'Muestra' END AS col FROM coded),
r AS (SELECT DISTINCT project_id, extraction_id, estudio FROM coded)
SELECT f.project_id, f.extraction_id, r.estudio AS study, CASE col WHEN 'Rara' THEN 'Estudio' ELSE col END AS key, CASE col WHEN 'Rara' THEN '[Rara] revise' ELSE 'revise' END AS detail
FROM f JOIN r ON r.project_id = f.project_id AND r.extraction_id = f.extraction_id AND (f.study IS NULL OR f.study = r.estudio)""")
def findings_on_cells(t: Tables) -> DataFrame:
    from quoteloom.plans.on_coded import _audit

    rows = coded(t).select("project_id", "extraction_id", matrix.whole_number(F.col("fila")["Estudio"]).alias("study"))
    raw = _audit(t).withColumn("verdict", F.lit("refutado"))
    out = matrix.findings_to_cells(reconcile.auditor_findings(raw), rows, codebook_columns(t))
    return out.select("project_id", "extraction_id", "study", "key", "detail")


# ------------------------------------------------------------------ rows
_BATCH = "SELECT project_id, study + 5 AS study, document, price, row_no FROM m WHERE status = 'P'"


def _batch(t: Tables) -> DataFrame:
    return wide(t).filter("status = 'P'").select("project_id", (F.col("study") + 5).alias("study"), "document", "price", "row_no")


@query("upserted_rows", f"""WITH {ORDERS}, b AS ({_BATCH}) SELECT project_id, study, document, price FROM b
UNION ALL SELECT project_id, study, document, price FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.project_id = m.project_id AND b.study = m.study)""")
def upserted_rows(t: Tables) -> DataFrame:
    old = wide(t).select("project_id", "study", "document", "price", "row_no")
    return matrix.upsert(old, _batch(t), ["project_id", "study"], "row_no").drop("row_no")


@query("replaced_count", f"""WITH {ORDERS}, b AS ({_BATCH}) SELECT m.project_id, count(*) AS replaced FROM m WHERE EXISTS (SELECT 1 FROM b WHERE b.project_id = m.project_id AND b.study = m.study) GROUP BY ALL""")
def replaced_count(t: Tables) -> DataFrame:
    return matrix.replaced_count(wide(t), _batch(t), ["project_id", "study"])


@query("reserved_studies", f"""WITH {ORDERS}, n AS (SELECT project_id, greatest(CASE project_id WHEN '1' THEN 1000000 ELSE 1 END, max(study) + 1) AS base FROM m GROUP BY project_id)
SELECT m.project_id, m.study AS request_no, base + row_number() OVER (PARTITION BY m.project_id ORDER BY m.study) - 1 AS study FROM m JOIN n USING (project_id)""")
def reserved_studies(t: Tables) -> DataFrame:
    rows = wide(t)
    sequences = rows.select("project_id").distinct().withColumn("sequence", F.when(F.col("project_id") == "1", 1000000).otherwise(1))
    requests = rows.select("project_id", F.col("study").alias("request_no"))
    return matrix.reserve_studies(requests, matrix.next_study(rows, sequences)).select("project_id", "request_no", "study")


@query("page_of_rows", f"""WITH {ORDERS} SELECT project_id, study, document, (SELECT count(*) FROM m) AS total FROM m ORDER BY study LIMIT 100 OFFSET 100""")
def page_of_rows(t: Tables) -> DataFrame:
    return matrix.page_of_rows(wide(t), 2, 100).select("project_id", "study", "document", "total")


@query("cell_lookup", f"""WITH {CELLS} SELECT project_id, study, key, v FROM cells WHERE project_id = (SELECT project_id FROM m WHERE study = 4) AND study = 4 AND key = 'Fecha'""")
def cell_lookup(t: Tables) -> DataFrame:
    project = wide(t).filter("study = 4").select("project_id").first()
    found = matrix.cell_by_key(cells(t), project.project_id if project else "", 4, "Fecha")
    return found.select("project_id", "study", "key", cell_text(F.col("value")).alias("v"))


@query("next_page_of_rows", f"""WITH {ORDERS} SELECT project_id, study, document, (SELECT count(*) FROM m) AS total FROM m WHERE study > 700 ORDER BY study LIMIT 600""")
def next_page_of_rows(t: Tables) -> DataFrame:
    """The page behind a study, found by key; longer than a screen."""
    return matrix.page_of_rows(wide(t), size=600, after=700).select("project_id", "study", "document", "total")


@query("outdated_rows", f"""WITH {ORDERS} SELECT project_id, study, study % 11 = 0 OR (origin = 'EXTRAIDA' AND study % 3 <> 1) AS outdated FROM m""")
def outdated_rows(t: Tables) -> DataFrame:
    rows = wide(t).withColumns({"codebook_id": F.concat(F.lit("v"), (F.col("study") % 3).cast("string")), "outdated": F.col("study") % 11 == 0})
    active = rows.select("project_id").distinct().withColumn("codebook_id", F.lit("v1"))
    return matrix.mark_outdated(rows, active).select("project_id", "study", "outdated")


# ------------------------------------------------------------------ marks
_MARKED = f"""{CELLS}, marked AS (SELECT *, CASE WHEN review_state = 'NO_VERIFICABLE' OR (key = 'Precio' AND study % 7 = 0) THEN 'rojo' WHEN key = 'Precio' AND study % 8 = 0 THEN 'naranja'
  WHEN review_state = 'POR_CONFIRMAR' THEN 'amarillo-borde' WHEN value_type = 'INFERIDO' THEN 'amarillo' WHEN review_state = 'SIN_EVIDENCIA' THEN 'gris' ELSE 'ninguno' END AS mark FROM cells)"""


def _summary(t: Tables) -> DataFrame:
    w = wide(t)
    price = w.select("project_id", "study", F.lit("Precio").alias("key"))
    findings = price.filter("study % 7 = 0").withColumn("state", F.lit("PENDIENTE"))
    return matrix.cell_summary(cells(t), price.filter("study % 8 = 0"), findings, price.filter("study % 3 = 0"))


def _marked(t: Tables) -> DataFrame:
    return _summary(t).withColumn("mark", matrix.mark())


@query("cell_summary", f"""WITH {CELLS} SELECT project_id, study, key, review_state, value_type, key = 'Precio' AND study % 8 = 0 AS discrepancy, key = 'Precio' AND study % 7 = 0 AS finding,
  key = 'Precio' AND study % 3 = 0 AS inherited_note FROM cells""")
def cell_summary(t: Tables) -> DataFrame:
    return _summary(t).select("project_id", "study", "key", "review_state", "value_type", "discrepancy", "finding", "inherited_note")


@query("cell_marks", f"WITH {_MARKED} SELECT project_id, study, key, mark FROM marked")
def cell_marks(t: Tables) -> DataFrame:
    return _marked(t).select("project_id", "study", "key", "mark")


@query("mark_counts", f"WITH {_MARKED} SELECT mark, count(*) AS n FROM marked GROUP BY ALL")
def mark_counts(t: Tables) -> DataFrame:
    return matrix.mark_counts(_marked(t))


@query("rows_with_marks", f"WITH {_MARKED} SELECT DISTINCT project_id, study FROM marked WHERE mark IN ('naranja', 'amarillo')")
def rows_with_marks(t: Tables) -> DataFrame:
    return matrix.rows_with_marks(_marked(t), ["naranja", "amarillo"])


@query("columns_with_marks", f"WITH {_MARKED} SELECT DISTINCT project_id, key FROM marked WHERE mark IN ('rojo', 'naranja')")
def columns_with_marks(t: Tables) -> DataFrame:
    return matrix.columns_with_marks(_marked(t), ["rojo", "naranja"])


@query("rows_of_articles", f"WITH {ORDERS} SELECT DISTINCT project_id, study, article_id FROM m WHERE article_id IS NOT NULL AND document % 2 = 0")
def rows_of_articles(t: Tables) -> DataFrame:
    chosen = wide(t).filter("document % 2 = 0").select("project_id", "article_id").distinct()
    return matrix.rows_of_articles(cells(t), chosen)


_PLACE = "CASE key " + " ".join(f"WHEN '{k}' THEN {i}" for k, i, _ in _KEYS) + " END"
_URGENCY = "CASE mark WHEN 'rojo' THEN 0 WHEN 'naranja' THEN 1 WHEN 'amarillo-borde' THEN 2 WHEN 'amarillo' THEN 3 ELSE 4 END"


@query("review_queue", f"""WITH {_MARKED} SELECT project_id, study, key, {_URGENCY}::BIGINT AS priority, row_number() OVER (PARTITION BY project_id ORDER BY {_URGENCY}, study, {_PLACE}) AS rank
FROM marked WHERE origin = 'EXTRAIDA' AND (v IS NOT NULL OR evidence_count > 0)""")
def review_queue(t: Tables) -> DataFrame:
    return matrix.review_queue(_marked(t)).select("project_id", "study", "key", "priority", "rank")


@query("pending_cells", f"""WITH {_MARKED} SELECT project_id, study, key, row_number() OVER (PARTITION BY project_id ORDER BY study, {_PLACE}) AS rank
FROM marked WHERE origin = 'EXTRAIDA' AND mark <> 'gris'""")
def pending_cells(t: Tables) -> DataFrame:
    return matrix.pending_cells(_marked(t)).select("project_id", "study", "key", "rank")


@query("related_inferences", f"""WITH {ORDERS} SELECT project_id, study, k AS key, 'Precio (celda)' AS name FROM m, (SELECT unnest(['Precio', 'Fecha']) AS k)
WHERE NOT (k = 'Precio' AND study % 10 = 0)""")
def related_inferences(t: Tables) -> DataFrame:
    """The price is named in the inference; the date has a trace field that is named too."""
    w = wide(t)
    inferences = w.select("project_id", "study", F.lit("Precio (celda)").alias("name"), F.lit("por suma").alias("reasoning"))
    fields = w.select("project_id").distinct().select("project_id", F.lit("Fecha").alias("key"), F.array(F.lit("celda")).alias("fields"))
    return matrix.related_inferences(cells(t), inferences, fields).select("project_id", "study", "key", "name")


@query("category_meanings", f"""WITH {ORDERS} SELECT project_id, study, 'Prioridad' AS key, 0::BIGINT AS part_no, priority AS part, 'sentido de ' || lower(priority) AS meaning FROM m WHERE NOT starts_with(priority, 'Otro')""")
def category_meanings(t: Tables) -> DataFrame:
    names = t.read("orders").select(F.col("o_orderpriority").alias("c")).distinct()
    meanings = wide(t).select("project_id").distinct().join(names, F.col("c").startswith(F.col("project_id")) & ~F.col("c").startswith("5")).select(
        "project_id", F.lit("Prioridad").alias("key"), F.lower("c").alias("category"), F.concat(F.lit("sentido de "), F.lower("c")).alias("meaning"))
    return matrix.category_meanings(cells(t), meanings).select("project_id", "study", "key", "part_no", "part", "meaning")


@query("document_lookups", f"""WITH {ORDERS} SELECT project_id, article_id, arg_max(document + study % 3, study) AS document FROM m WHERE article_id IS NOT NULL GROUP BY ALL""")
def document_lookups(t: Tables) -> DataFrame:
    return matrix.document_lookups(wide(t).withColumn("document", F.col("document") + F.col("study") % 3))


@query("covidence_lookup", f"""WITH {ORDERS} SELECT project_id, document, arg_max(study % 7, study) AS covidence FROM m WHERE study % 7 > 0 GROUP BY ALL""")
def covidence_lookup(t: Tables) -> DataFrame:
    own = wide(t).select("project_id", "study", "document", F.lit("Covidence #").alias("key"), int_cell(F.col("study") % 7).cast(CELL_TYPE).alias("value"))
    return matrix.covidence_lookup(own)


# ------------------------------------------------------------------ review: events of users act on the price and date of orders
_ACTS = f"""{CELLS}, acts AS (SELECT m.project_id, m.study, CASE WHEN event_id % 2 = 0 THEN 'Prioridad' ELSE 'Fecha' END AS key, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'RECHAZAR' WHEN 'purchase' THEN 'CORREGIR' ELSE 'APROBAR' END AS action, CASE WHEN event_type = 'click' THEN NULL WHEN event_id % 13 = 0 THEN ' ' ELSE 'visto' END AS reason,
  CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN '' ELSE 'ana' END AS author, CASE WHEN event_id % 4 < 2 THEN '1-URGENT' ELSE 'mala' END AS new_value
  FROM events JOIN m ON m.study = user_id),
base AS (SELECT a.*, c.review_state AS opened, trim(coalesce(reason, '')) = '' AS bare FROM acts a JOIN cells c ON c.project_id = a.project_id AND c.study = a.study AND c.key = a.key),
own AS (SELECT *, CASE WHEN action = 'CORREGIR' AND bare THEN 'Corregir exige motivo' WHEN action = 'CORREGIR' AND key = 'Prioridad' AND new_value = 'mala' THEN 'valor fuera de los permitidos'
  WHEN action = 'RECHAZAR' AND bare THEN 'Rechazar exige motivo' WHEN author = '' THEN 'Toda acción de revisión exige autor' END AS own FROM base),
firsts AS (SELECT project_id, study, key, min(seq) AS free FROM own WHERE own IS NULL AND NOT (action = 'APROBAR' AND bare) GROUP BY ALL),
judged AS (SELECT o.*, CASE WHEN own IS NOT NULL THEN own WHEN action = 'APROBAR' AND bare AND opened IN ('NO_VERIFICABLE', 'POR_CONFIRMAR', 'SIN_EVIDENCIA') AND NOT coalesce(f.free < o.seq, FALSE)
  THEN 'Aprobar una celda ' || opened || ' exige motivo' END AS refusal FROM own o LEFT JOIN firsts f ON f.project_id = o.project_id AND f.study = o.study AND f.key = o.key)"""


def actions(t: Tables) -> DataFrame:
    e = t.read("events")
    kind, n = F.col("event_type"), F.col("event_id")
    return e.join(wide(t).select("project_id", F.col("study").alias("user_id")).hint("merge"), "user_id").select(
        "project_id", F.col("user_id").alias("study"), F.when(n % 2 == 0, "Prioridad").otherwise("Fecha").alias("key"), n.alias("seq"),
        F.when(kind == "error", "RECHAZAR").when(kind == "purchase", "CORREGIR").otherwise("APROBAR").alias("action"),
        F.when(kind == "click", None).when(n % 13 == 0, " ").otherwise("visto").alias("reason"),
        F.when((kind == "signup") & (n % 5 == 0), "").otherwise("ana").alias("author"),
        text_cell(F.when(n % 4 < 2, "1-URGENT").otherwise("mala")).cast(CELL_TYPE).alias("new_value"), F.lit(None).cast("string").alias("new_data_state"))


def judged(t: Tables) -> DataFrame:
    return review.judged_actions(actions(t), cells(t), columns(t))


@query("judged_actions", f"WITH {_ACTS} SELECT project_id, study, key, seq, action, refusal FROM judged")
def judged_actions(t: Tables) -> DataFrame:
    return judged(t).select("project_id", "study", "key", "seq", "action", "refusal")


@query("refused_actions", f"WITH {_ACTS} SELECT project_id, study, key, seq, action, refusal FROM judged WHERE refusal IS NOT NULL")
def refused_actions(t: Tables) -> DataFrame:
    return review.refused(judged(t))


@query("reviewed_cells", f"""WITH {_ACTS}, f AS (SELECT project_id, study, key, arg_max(action, seq) AS last, arg_max(new_value, seq) FILTER (action = 'CORREGIR') AS fixed, count(*) AS n FROM judged WHERE refusal IS NULL GROUP BY ALL)
SELECT c.project_id, c.study, c.key, coalesce(f.fixed, c.v) AS v, CASE f.last WHEN 'APROBAR' THEN 'APROBADA' WHEN 'CORREGIR' THEN 'CORREGIDA' WHEN 'RECHAZAR' THEN 'RECHAZADA' ELSE c.review_state END AS review_state,
  coalesce(f.n, 0) AS actions FROM cells c LEFT JOIN f ON f.project_id = c.project_id AND f.study = c.study AND f.key = c.key""")
def reviewed_cells(t: Tables) -> DataFrame:
    return review.reviewed_cells(cells(t), judged(t)).select("project_id", "study", "key", cell_text(F.col("value")).alias("v"), "review_state", "actions")


@query("review_history", f"""WITH {_ACTS}, ok AS (SELECT j.*, c.v FROM judged j JOIN cells c ON c.project_id = j.project_id AND c.study = j.study AND c.key = j.key WHERE refusal IS NULL),
h AS (SELECT *, coalesce(last_value(CASE WHEN action = 'CORREGIR' THEN new_value END IGNORE NULLS) OVER (PARTITION BY project_id, study, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v) AS old FROM ok)
SELECT project_id, study, key, seq, action, old AS old_value, CASE WHEN action = 'CORREGIR' THEN new_value ELSE old END AS new_value FROM h""")
def review_history(t: Tables) -> DataFrame:
    h = review.history(cells(t), judged(t))
    return h.select("project_id", "study", "key", "seq", "action", cell_text(F.col("old_value")).alias("old_value"), cell_text(F.col("new_value")).alias("new_value"))


_NUMERIC = "key IN ('Prioridad', 'Fecha')"
_APPROVALS = f"""{_ACTS}, asks AS (SELECT m.project_id, m.study, event_id AS request_seq FROM events JOIN m ON m.study = user_id WHERE event_type = 'view'),
st AS (SELECT a.project_id, a.study, a.request_seq, c.key, c.position, coalesce(arg_max(j.action, j.seq), 'x') AS act FROM asks a JOIN cells c ON c.project_id = a.project_id AND c.study = a.study AND {_NUMERIC}
  LEFT JOIN judged j ON j.project_id = c.project_id AND j.study = c.study AND j.key = c.key AND j.refusal IS NULL AND j.seq < a.request_seq GROUP BY ALL),
approvals AS (SELECT project_id, study, request_seq, count(*) FILTER (act NOT IN ('APROBAR', 'CORREGIR')) = 0 AS allowed,
  coalesce(string_agg(CASE WHEN act NOT IN ('APROBAR', 'CORREGIR') THEN key END, ', ' ORDER BY position), '') AS blockers FROM st GROUP BY ALL)"""


def _approvals(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Requests come from views; priority and date stand for the numeric columns."""
    requests = t.read("events").filter("event_type = 'view'").join(wide(t).select("project_id", F.col("study").alias("user_id")).hint("merge"), "user_id").select(
        "project_id", F.col("user_id").alias("study"), F.col("event_id").alias("seq"), F.lit("ana").alias("author"))
    cols = columns(t).withColumn("is_numeric", F.col("key").isin("Prioridad", "Fecha"))
    done = judged(t)
    return review.row_approvals(requests, cells(t), cols, done), done


@query("row_approvals", f"WITH {_APPROVALS} SELECT project_id, study, request_seq, allowed, blockers FROM approvals")
def row_approvals(t: Tables) -> DataFrame:
    return _approvals(t)[0]


@query("approved_rows", f"""WITH {_APPROVALS}, u AS (SELECT project_id, study, max(seq) AS undone FROM judged WHERE refusal IS NULL AND action IN ('CORREGIR', 'RECHAZAR') GROUP BY ALL),
a AS (SELECT project_id, study, max(request_seq) AS approved_at FROM approvals WHERE allowed GROUP BY ALL)
SELECT a.project_id, a.study, approved_at, approved_at > coalesce(undone, -1) AS approved FROM a LEFT JOIN u ON u.project_id = a.project_id AND u.study = a.study""")
def approved_rows(t: Tables) -> DataFrame:
    return review.approved_rows(*_approvals(t))


# ------------------------------------------------------------------ export
@query("inherited_slots")
def inherited_slots(t: Tables) -> DataFrame:
    """Orders with their own sheet row, some without one and some that share one."""
    rows = wide(t).select(F.col("document").cast("string").alias("project_id"), "study",
                          F.when(F.col("status") == "P", None).otherwise(F.col("study") % 97 + 2).alias("origin_row"))
    return export.place_inherited(rows)


@query("inherited_slots_plain", f"WITH {ORDERS} SELECT project_id, study, study + 2 AS origin_row, study + 2 AS sheet_row FROM m")
def inherited_slots_plain(t: Tables) -> DataFrame:
    """Without a clash every row keeps its place."""
    return export.place_inherited(wide(t).select("project_id", "study", (F.col("study") + 2).alias("origin_row")))


@query("extracted_slots", f"""WITH {ORDERS}, sheet AS (SELECT project_id, study, study + 2 AS sheet_row FROM m WHERE status <> 'P'), n AS (SELECT project_id, max(sheet_row) AS last FROM sheet GROUP BY ALL),
new AS (SELECT m.project_id, m.study, row_number() OVER (PARTITION BY m.project_id ORDER BY m.study) AS k FROM m WHERE status = 'P')
SELECT project_id, study, study + 2 AS sheet_row FROM m WHERE status = 'O' UNION ALL SELECT new.project_id, study, last + k FROM new JOIN n USING (project_id)""")
def extracted_slots(t: Tables) -> DataFrame:
    w = wide(t)
    sheet = w.filter("status <> 'P'").select("project_id", "study", (F.col("study") + 2).alias("sheet_row"))
    return export.place_extracted(w.filter("status <> 'F'").select("project_id", "study", F.col("study").alias("batch_no")), sheet)


_TRACE_KINDS = f"""WITH {CODED} SELECT project_id, extraction_id, row_pos, 'Muestra' AS "column", 0::BIGINT AS idx, CASE WHEN muestra IS NULL THEN 'null' ELSE CAST(muestra AS STRING) END AS value,
  CASE WHEN ev_muestra THEN quote_muestra END AS quote, CASE WHEN muestra IS NULL THEN 'Faltante' WHEN inferred THEN 'Inferido' ELSE 'Literal o codificado' END AS kind,
  CASE WHEN muestra IS NULL THEN st_muestra END AS note FROM coded
UNION ALL SELECT project_id, extraction_id, row_pos, 'Muestra (fila 1)', 0, sample, NULL, 'Inferencia', 'regla 4: por contexto' FROM coded WHERE inferred
UNION ALL SELECT project_id, extraction_id, row_pos, 'Nivel', 0, nivel, NULL, 'Discrepancia del artículo', 'Tabla 1 || texto' FROM coded WHERE disputed
UNION ALL SELECT project_id, extraction_id, row_pos, NULL, 0, NULL, NULL, 'Advertencia', 'Lenguaje CAUSAL en la conclusión' FROM coded WHERE warned
UNION ALL SELECT project_id, extraction_id, row_pos, 'confianza', 0, 'alta', NULL, 'Resumen', 'extractor: uno; fecha: 2026-10-05; verificador: dos' FROM coded"""


@query("traceability_rows", _TRACE_KINDS)
def traceability_rows(t: Tables) -> DataFrame:
    out = export.traceability(coded(t), codebook_columns(t)).filter("column = 'Muestra' or section > 1")
    return out.select("project_id", "extraction_id", "row_pos", "column", "idx", "value", "quote", "kind", "note")


@query("traceability_counts", f"""WITH {CODED} SELECT project_id, count(*) * 30 + count(*) FILTER (inferred) + count(*) FILTER (disputed) + count(*) FILTER (warned) AS n FROM coded GROUP BY ALL""")
def traceability_counts(t: Tables) -> DataFrame:
    return export.traceability(coded(t), codebook_columns(t)).groupBy("project_id").agg(F.count("*").alias("n"))


@query("audit_of_studies", f"""WITH {CODED}, f AS (SELECT project_id, estudio, items1 FROM coded WHERE items1 NOT IN (0, 4)) SELECT project_id, estudio AS study, count(*) AS n FROM f WHERE estudio < 4 GROUP BY ALL""")
def audit_of_studies(t: Tables) -> DataFrame:
    from quoteloom.plans.on_coded import _audit

    audit = reconcile.audit_rows(reconcile.auditor_findings(_audit(t)))
    studies = coded(t).select("project_id", matrix.whole_number(F.col("fila")["Estudio"]).alias("study")).filter("study < 4")
    return export.audit_of_studies(audit, studies).groupBy("project_id", "study").agg(F.count("*").alias("n"))


_COMMENT = "'p. 3 | Tabla 2 | fila: SWB' || chr(10) || '\"' || quote_muestra || '\"'"
_WHY = "'POR QUÉ (inferido, regla 4): por contexto'"


@query("cell_comments", f"""WITH {CODED}, c AS (SELECT *, CASE WHEN ev_muestra THEN {_COMMENT} WHEN muestra IS NULL THEN st_muestra END AS base FROM coded)
SELECT project_id, extraction_id, row_pos, 'Muestra' AS key, CASE WHEN inferred THEN coalesce(base || chr(10) || chr(10), '') || {_WHY} ELSE base END AS comment, inferred, FALSE AS discrepancy FROM c
UNION ALL SELECT project_id, extraction_id, row_pos, 'Nivel', CASE WHEN disputed THEN 'DISCREPANCIA DEL ARTÍCULO: Tabla 1 || texto -> adoptado: ' || nivel END, FALSE, disputed FROM coded""")
def cell_comments(t: Tables) -> DataFrame:
    out = export.cell_comments(coded(t), codebook_columns(t)).filter(F.col("key").isin("Muestra", "Nivel"))
    return out.select("project_id", "extraction_id", "row_pos", "key", "comment", "inferred", "discrepancy")


_KEY_LIST = "[" + ", ".join("'" + k.replace("'", "''") + "'" for k in FILA) + "]"


@query("cell_fills", f"""WITH {CODED}, p AS (SELECT DISTINCT project_id, estudio FROM coded WHERE items1 IN (1, 2)), k AS (SELECT unnest({_KEY_LIST}) AS key)
SELECT c.project_id, extraction_id, row_pos, key, CASE WHEN key = 'Muestra' AND p.estudio IS NOT NULL THEN 'rojo' WHEN key = 'Nivel' AND disputed THEN 'naranja'
  WHEN key = 'Muestra' AND inferred THEN 'amarillo' END AS fill FROM coded c CROSS JOIN k LEFT JOIN p ON p.project_id = c.project_id AND p.estudio = c.estudio""")
def cell_fills(t: Tables) -> DataFrame:
    """Every column of every row, under all findings of the auditor that wait."""
    from quoteloom.plans.on_coded import _audit

    comments = export.cell_comments(coded(t), codebook_columns(t))
    return export.cell_fills(comments, reconcile.audit_rows(reconcile.auditor_findings(_audit(t)))).select("project_id", "extraction_id", "row_pos", "key", "fill")


@query("replaced_studies", f"""WITH {ORDERS} SELECT project_id, study, 'vieja' AS version FROM m WHERE status = 'F' UNION ALL SELECT project_id, study, 'nueva' FROM m WHERE status <> 'F'""")
def replaced_studies(t: Tables) -> DataFrame:
    w = wide(t)
    old = w.select("project_id", "study", F.lit("vieja").alias("version"))
    return export.replace_studies(old, w.filter("status <> 'F'").select("project_id", "study", F.lit("nueva").alias("version")))


@query("round_trip", f"""WITH {CELLS} SELECT project_id, study, key FROM cells WHERE key = 'Precio' AND v IS NOT NULL AND study % 10 = 3""")
def round_trip(t: Tables) -> DataFrame:
    """Cells written to a sheet and read back, with a price changed in some rows."""
    before = cells(t).select("project_id", "study", "key", cell_json(F.col("value")).alias("v"))
    lost = (F.col("key") == "Precio") & (F.col("study") % 10 == 3) & (F.col("v") != "null")
    after = before.withColumn("v", F.when(lost, "0").otherwise(F.col("v")))
    return export.round_trip_differences(before, after, ["project_id", "study", "key"], ["v"]).select("project_id", "study", "key")
