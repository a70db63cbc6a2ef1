"""Queries on coded rows: rules, comparison and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.typed import CELL_TYPE, cell_json, float_cell, int_cell, null_cell, text_cell
from quoteloom.operators import compare, reconcile, rules
from quoteloom.operators.anchoring import evidence_of
from quoteloom.plans.derived import BLOCKS, CODED, EVIDENCE, coded, coded_flat, coded_wide, codebook_columns, compared_values, evidence, shown_blocks, sql_norm, stored_blocks
from quoteloom.plans.registry import SQL, Tables, query
from quoteloom.session import cut_lineage
from quoteloom.sources.coded import coded_rows

OUT = ["project_id", "extraction_id", "row_pos", "rule", "severity", "column", "message"]


# ------------------------------------------------------------------ row rules
def _sql(rule: str, severity: str, checks: list[tuple[str, str, str]], cte: str = CODED, source: str = "coded") -> str:
    """Violations of one rule from (column, condition, message expression) triples."""
    parts = [f"""SELECT project_id, extraction_id, row_pos, '{rule}' AS rule, '{severity}' AS severity, '{col}' AS "column", {said} AS message FROM {source} WHERE {cond}"""
             for col, cond, said in checks]
    return f"WITH {cte} " + " UNION ALL ".join(parts)


def _say(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SURNAME = "CASE l WHEN 'Ana Lopez' THEN 'lopez' WHEN 'Luis Ruiz; Eva Diaz' THEN 'ruiz' ELSE 'singh' END".replace("l WHEN", "author WHEN", 1)
_FORM = "CASE WHEN contains(cita, 'et al.') THEN 3 WHEN contains(cita, ' y ') THEN 2 ELSE 1 END"
_AUTHORS = "CASE author WHEN 'Ana Lopez' THEN 1 WHEN 'Luis Ruiz; Eva Diaz' THEN 2 ELSE 3 END"
_VALID = "cita <> 'sin formato'"
_NUMBERS = r"list_transform(regexp_extract_all(transcript, '-?\d*[.,]\d+|-?\d+'), lambda x: abs(TRY_CAST(replace(x, ',', '.') AS DOUBLE)))"
_TREE = """CASE WHEN muestra IS NULL THEN 1 WHEN r IS NULL AND beta IS NULL AND NOT zero AND NOT others AND r_derived IS NULL THEN 2
  WHEN nivel = 'Group' THEN 3 WHEN design = 'Randomised controlled trial' THEN 4 WHEN nivel = 'Multinivel' THEN 5
  WHEN (r IS NOT NULL AND method = 'Pearson observado') OR r_derived IS NOT NULL THEN 6 WHEN r_imputed IS NOT NULL THEN 7
  WHEN method = 'Correlación entre compuestos PLS' OR technique = 'PLS' THEN 8
  WHEN method = 'Correlación entre variables latentes CB-SEM' OR technique = 'CB-SEM latente' THEN 9 WHEN zero THEN 10 ELSE 11 END"""
_TREE_CTE = f"""{CODED}, tree AS (SELECT *, {_TREE} AS cond FROM coded), chosen AS (SELECT *,
  ['No', 'No', 'Organizacional', 'Experimental', 'Multinivel', 'SI', 'SI', 'PLS', 'SEM latente', 'No', 'No'][cond] AS cat FROM tree)"""
_ALLOWED = "(beta IS NOT NULL AND abs(beta) <= 0.5 AND technique = 'Regresión' AND effect = 'parcial')"
_COEF = "coalesce(r, beta)"
_DATES = "list_filter([start_date, end_date], lambda x: x <> 'No indica')"

_NAME = "CASE author WHEN 'Ana Lopez' THEN 'Lopez' WHEN 'Luis Ruiz; Eva Diaz' THEN 'Ruiz' ELSE 'Singh' END"
_EXPECTED = "CASE WHEN cond = 6 THEN 'Principal' WHEN cond IN (5, 7, 8, 9, 10) THEN 'Sensibilidad' ELSE 'Narrativo' END"
_R_COL, _BETA_COL, _REL_P, _REL_H = "Correlación Feli 1 - JP", "Beta Fel 1- JP", "Fiabilidad Alfa - Omega (desempeño)", "Fiabilidad Alfa - Omega (felicidad)"
_LACKS = {k: _say(f"'{k}' es null sin código en estado_del_dato") for k in (_REL_P, _REL_H, "Muestra", _R_COL, _BETA_COL)}
ROW_SQL = {
    "V03": _sql("V03", "E", [("Cita", f"NOT {_VALID}", "'Cita con formato inválido: ' || cita"),
                             ("Cita", f"{_VALID} AND lower(regexp_extract(cita, '^([^ ]+)', 1)) <> {_SURNAME}",
                              f"'Cita ''' || cita || ''' no empieza con el apellido del primer autor ''' || {_NAME} || ''''"),
                             ("Cita", f"{_VALID} AND TRY_CAST(regexp_extract(cita, '\\((\\d{{4}})', 1) AS INT) <> anio", "'Año de la Cita distinto de Año'"),
                             ("Cita", f"{_VALID} AND {_FORM} <> {_AUTHORS}", f"'Cita no sigue la regla del número de autores (' || {_AUTHORS} || ' autores)'")]),
    "V06": _sql("V06", "E", [(_REL_P, "rel_p IS NULL AND st_rel_p IS NULL", _LACKS[_REL_P]), (_REL_H, "rel_h IS NULL AND st_rel_h IS NULL", _LACKS[_REL_H]),
                             ("Muestra", "muestra IS NULL AND st_muestra IS NULL", _LACKS["Muestra"]), (_R_COL, "r IS NULL AND st_r IS NULL", _LACKS[_R_COL]),
                             (_BETA_COL, "beta IS NULL", _LACKS[_BETA_COL]),
                             ("Covidence #", "covidence IS NULL AND via = 'Covidence'", "'Covidence # vacío pero via_de_identificacion = Covidence'")]),
    "V09": _sql("V09", "E", [("Muestra", "muestra IS NULL AND include <> 'No'", "'Muestra null exige Incluir = No'")]),
    "V10": _sql("V10", "E", [(c, f"{a} IS NOT NULL AND len(list_filter({_NUMBERS}, lambda x: abs(abs({a}) - x) < 0.0005)) = 0",
                              f"'{c} = ' || CAST({a} AS VARCHAR) || ' no aparece en la transcripción'") for c, a in ((_R_COL, "r"), (_BETA_COL, "beta"))]),
    "V11": _sql("V11", "E", [(_REL_P, "items = 1 AND NOT (rel_p IS NULL AND st_rel_p IS NOT DISTINCT FROM 'No aplica')",
                              "'Desempeño de un ítem: la fiabilidad debe ser null con estado No aplica'"),
                             (_REL_H, "items1 = 1 AND NOT (rel_h IS NULL AND st_rel_h IS NOT DISTINCT FROM 'No aplica')",
                              "'Felicidad de un ítem: la fiabilidad debe ser null con estado No aplica'")]),
    "V12": _sql("V12", "E", [("Incluir en meta análisi", "include <> cat", "'Incluir = ' || include || ' pero el árbol da ' || cat || ' (condición ' || cond || ')'"),
                             ("Incluir en meta análisi", "include = cat AND NOT starts_with(motive, 'Condición ' || cond || ':')",
                              "'motivo_decision_inclusion debe empezar con ''Condición ' || cond || ':'''")], _TREE_CTE, "chosen"),
    "V14": _sql("V14", "E", [(_BETA_COL, f"r_imputed IS NOT NULL AND NOT {_ALLOWED}", "'r_imputado_desde_beta no permitido para este beta'"),
                             (_BETA_COL, f"r_imputed IS NOT NULL AND {_ALLOWED} AND abs(r_imputed - (0.98 * beta + CASE WHEN beta >= 0 THEN 0.05 ELSE 0 END)) > 0.001",
                              "'r_imputado_desde_beta no coincide con Peterson y Brown'")]),
    "V15": _sql("V15", "A", [(_R_COL, f"{_COEF} < 0 AND contains(direction, 'HP')", "'Coeficiente negativo con HP'"),
                             (_R_COL, f"{_COEF} > 0 AND contains(direction, 'Relación negativa')", "'Coeficiente positivo con Relación negativa'")]),
    "V16": _sql("V16", "A", [("Validez?", "(valid = 'Si') = (scales = 'No indica')", "'Validez? y Validez de las escalas no son coherentes'")]),
    "V17": _sql("V17", "A", [("CFA", "(valid_cfa = 'Si' OR cfa = 'Si') AND NOT regexp_matches(scales, '(?i)AFC|CFA|confirmator')",
                              "'CFA = Si pero Validez de las escalas no menciona AFC'")]),
    "V18": _sql("V18", "A", [("Start date", f"len({_DATES}) = 2 AND start_date > end_date", "'Start date posterior a End date'"),
                             ("Start date", f"len(list_filter({_DATES}, lambda x: CAST(substr(x, 1, 4) AS INT) > anio)) > 0",
                              "'Fecha de recolección posterior al año de publicación'")]),
    "V19": _sql("V19", "A", [(c, f"{a} < 0.7", f"'{c} = ' || CAST({a} AS VARCHAR) || ' menor a 0.70: confirmar'") for c, a in ((_REL_P, "rel_p"), (_REL_H, "rel_h"))]),
    "V21": _sql("V21", "A", [("Conclusion", "design = 'Cross sectional study' AND regexp_matches(conclusion, '(?i)\\bcaus|provoca|efecto causal') AND NOT warned",
                              "'Diseño transversal con lenguaje causal en Conclusion; anotarlo en advertencias_pendientes'")]),
    "V26": _sql("V26", "A", [(_BETA_COL, "abs(beta) > 1", "'|Beta| > 1: confirmar que es estandarizado'")]),
    "V27": _sql("V27", "E", [("conjunto_sugerido", f"chosen_set <> {_EXPECTED}", f"'conjunto_sugerido = ' || chosen_set || ', esperado ' || {_EXPECTED}")],
                _TREE_CTE, "chosen"),
    "V28": _sql("V28", "A", [(_R_COL, "effect = 'simple' AND abs(r - beta) > 0.05", "'Efecto simple con r = ' || CAST(r AS VARCHAR) || ' y Beta = ' || CAST(beta AS VARCHAR) || ': revisar'")]),
    "V29": _sql("V29", "E", [(_R_COL, "r_derived IS NOT NULL AND technique IN ('CB-SEM latente', 'PLS') AND method IS DISTINCT FROM 'Pearson observado'",
                              "'r_derivado no puede provenir de un beta latente'")]),
}


def _row_rule(rule: str) -> None:
    @query(f"rule_{rule.lower()}", ROW_SQL[rule])
    def one(t: Tables, rule: str = rule) -> DataFrame:
        return rules.row_violations(coded(t, looked_up=True), [rule]).select(*OUT)


for _rule in ROW_SQL:
    _row_rule(_rule)


@query("row_rules_all", " UNION ALL ".join(f"(SELECT * FROM ({s}))" for s in ROW_SQL.values()))
def row_rules_all(t: Tables) -> DataFrame:
    """Every row rule in one pass."""
    return rules.row_violations(coded(t, looked_up=True)).select(*OUT)


@query("rule_v01", f"""WITH {CODED}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id, extraction_id, estudio ORDER BY row_pos) AS k FROM coded)
SELECT project_id, extraction_id, row_pos, 'V01' AS rule, 'E' AS severity, 'Estudio' AS "column", 'Estudio ' || estudio || ' repetido' AS message FROM n WHERE k > 1""")
def rule_v01(t: Tables) -> DataFrame:
    return rules.v01_repeated_study(coded(t, looked_up=True)).select(*OUT)


_DOC_LEVEL = {"Pais": "country", "Año": "CAST(anio AS STRING)", "Author": "author", "Study design": "design"}


@query("rule_v02", f"""WITH {CODED}, v AS ({" UNION ALL ".join(f"SELECT project_id, extraction_id, documento, '{k}' AS c, {e} AS v FROM coded" for k, e in _DOC_LEVEL.items())})
SELECT project_id, extraction_id, CAST(documento AS STRING) AS document, 'V02' AS rule, 'E' AS severity, c AS "column",
  'Documento ' || documento || ': ''' || c || ''' cambia entre filas' AS message FROM v GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def rule_v02(t: Tables) -> DataFrame:
    return rules.v02_document_constant(coded(t), rules.codebook_meta(codebook_columns(t)))


@query("rule_v13", f"""WITH {CODED}, bad AS (
  SELECT *, 'Muestra' AS c FROM coded WHERE muestra IS NOT NULL AND NOT ev_muestra UNION ALL
  SELECT *, 'Correlación Feli 1 - JP' FROM coded WHERE r IS NOT NULL AND NOT ev_r UNION ALL SELECT *, 'Nivel' FROM coded)
SELECT project_id, extraction_id, row_pos, 'V13' AS rule, 'E' AS severity, c AS "column", '''' || c || ''' tiene valor sin evidencia' AS message FROM bad""")
def rule_v13(t: Tables) -> DataFrame:
    return rules.v13_evidence(coded(t), rules.codebook_meta(codebook_columns(t))).select(*OUT)


_SAMPLE = {"Pais": "country", "Población": "population", "Study design": "design", "Start date": "start_date", "End date": "end_date"}


@query("rule_v20", f"""WITH {CODED}, v AS ({" UNION ALL ".join(f"SELECT project_id, extraction_id, sample, '{k}' AS c, {e} AS v FROM coded" for k, e in _SAMPLE.items())})
SELECT project_id, extraction_id, sample, c AS "column", 'Muestra ' || sample || ': ''' || c || ''' cambia entre filas' AS message FROM v GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def rule_v20(t: Tables) -> DataFrame:
    return rules.v20_sample_constant(coded(t, looked_up=True)).select("project_id", "extraction_id", "sample", "column", "message")


@query("rule_v22", f"""WITH {CODED} SELECT project_id, extraction_id, row_pos, 'V22' AS rule, 'A' AS severity, 'Conclusion' AS "column", 'Posible nota de trabajo en ''Conclusion''' AS message FROM coded
WHERE regexp_matches(conclusion, '(?i)revisar|preguntar|no es claro|pendiente|\\?\\?')""")
def rule_v22(t: Tables) -> DataFrame:
    return rules.v22_working_notes(coded(t)).select(*OUT)


@query("rule_v23_literal", f"""WITH {EVIDENCE}, whole AS (SELECT project_id, doc_id, string_agg(text_norm, ' ' ORDER BY pos) AS body FROM blocks WHERE text_norm <> '' GROUP BY ALL)
SELECT e.project_id, e.doc_id, e.row_pos FROM evidence e LEFT JOIN whole w ON w.project_id = e.project_id AND w.doc_id = e.doc_id
WHERE NOT e.figure AND e.q <> '' AND NOT coalesce(contains(w.body, e.q), FALSE)""")
def rule_v23_literal(t: Tables) -> DataFrame:
    """Quotes that the text of their document lacks."""
    b = stored_blocks(t)
    return rules.v23_not_literal(evidence(t, b), b).select("project_id", "doc_id", "row_pos")


@query("rule_v23_words", """WITH q AS (SELECT doc_id, parts, unnest(range(0, len(parts))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
SELECT CAST(doc_id AS STRING) AS extraction_id, 0::BIGINT AS row_pos, 'V23' AS rule, 'E' AS severity, 'Muestra' AS "column", count(*) AS n FROM q
WHERE trim(parts[pos + 1]) <> '' AND len(string_split(trim(regexp_replace(parts[pos + 1], '\\s+', ' ', 'g')), ' ')) > 25 GROUP BY ALL""".replace("\\\\s", "\\s"))
def rule_v23_words(t: Tables) -> DataFrame:
    """The lines of each document as the evidence of one coded row."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(
        F.lit(1).alias("pagina_pdf"), F.lit("").alias("ubicacion"), F.lit(None).cast("string").alias("fila_tabla"), F.lit(None).cast("string").alias("columna_tabla"),
        x.alias("cita_textual"), F.lit(False).alias("leido_de_figura"), F.lit(None).cast("string").alias("bloque_id")))
    rows = t.documents.select(
        F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("extraction_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("row_pos"),
        F.create_map(F.lit("Estudio"), int_cell(F.col("doc_id")).cast(CELL_TYPE)).alias("fila"), F.struct(F.create_map(F.lit("Muestra"), lines).alias("evidencia")).alias("traz"))
    return rules.v23_long_quotes(rows).groupBy("extraction_id", "row_pos", "rule", "severity", "column").agg(F.count("*").alias("n"))


@query("rule_v25", f"""WITH {CODED} SELECT project_id, extraction_id, row_pos, 'V25' AS rule, 'A' AS severity, 'Tipo de felicidad real' AS "column", 'Tipo ' || happiness || ' corresponde a Hedónica, no a ' || family AS message FROM coded
WHERE (happiness IN ('Satisfacción laboral', 'Bienestar') AND family <> 'Hedónica')""")
def rule_v25(t: Tables) -> DataFrame:
    rows = coded(t)
    return rules.v25_happiness_type(rows, _types(t)).select(*OUT)


_SCHEMA_SQL = f"""WITH {CODED}, bad AS (
  SELECT *, 'Incluir en meta análisi' AS c, 'vocabulary' AS m FROM coded WHERE include NOT IN ('SI', 'No', 'PLS') UNION ALL
  SELECT *, 'Conclusion', 'type' FROM coded WHERE conclusion = 'se asocian' UNION ALL
  SELECT *, 'Población', 'missing key' FROM coded WHERE population = 'F' UNION ALL
  SELECT *, 'Sobrante', 'unknown column' FROM coded WHERE country = 'Chile' UNION ALL
  SELECT *, 'Cita', 'required' FROM coded WHERE cita = 'sin formato')"""


def _untidy(t: Tables) -> DataFrame:
    """Coded rows with schema faults put in where the data say so."""
    rows = coded(t)
    said = F.col("fila")["Conclusion"]["str"]
    fila = F.map_filter("fila", lambda k, v: ~((k == "Población") & (v["str"] == "F")))
    fila = F.transform_values(fila, lambda k, v: F.when((k == "Conclusion") & (said == "se asocian"), float_cell(F.lit(1.0)).cast(CELL_TYPE))
                              .when((k == "Cita") & (v["str"] == "sin formato"), null_cell().cast(CELL_TYPE)).otherwise(v))
    extra = F.create_map(F.lit("Sobrante"), text_cell(F.lit("x")).cast(CELL_TYPE))
    return rows.withColumn("fila", F.when(F.col("fila")["Pais"]["str"] == "Chile", F.map_concat(fila, extra)).otherwise(fila))


@query("schema_gate", f"""{_SCHEMA_SQL} SELECT project_id, extraction_id, row_pos, c AS "column", m AS message FROM bad""")
def schema_gate(t: Tables) -> DataFrame:
    return rules.schema_violations(_untidy(t), codebook_columns(t)).select("project_id", "extraction_id", "row_pos", "column", "message")


@query("schema_gate_passed", f"""{_SCHEMA_SQL} SELECT project_id, extraction_id, count(*) AS "rows" FROM coded c
WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.project_id = c.project_id AND b.extraction_id = c.extraction_id) GROUP BY ALL""")
def schema_gate_passed(t: Tables) -> DataFrame:
    rows = _untidy(t)
    passed = rules.pass_gate(rows, rules.schema_violations(rows, codebook_columns(t)))
    return passed.groupBy("project_id", "extraction_id").agg(F.count("*").alias("rows"))


def _types(t: Tables) -> DataFrame:
    """Happiness types of every project and the family each belongs to."""
    pairs = F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("family")) for a, b in (
        ("Satisfacción laboral", "Hedónica"), ("Bienestar", "Hedónica"), ("Orientación hedónica", "Hedónica"))])
    projects = t.read("lineitem").select(F.col("l_linestatus").alias("project_id")).distinct()
    return cut_lineage(projects.select("project_id", F.explode(pairs).alias("p")).select("project_id", "p.*"))


_GROUP_SQL = [SQL["rule_v01"], SQL["rule_v02"], SQL["rule_v13"], f"""SELECT *, 'V20' AS rule, 'A' AS severity FROM ({SQL["rule_v20"]})""", SQL["rule_v22"], SQL["rule_v25"]]
_PASSED = [f"""SELECT project_id, extraction_id, rule, severity, "column" FROM ({s})""" for s in (*ROW_SQL.values(), *_GROUP_SQL)]


@query("validated_rows", f"""{_SCHEMA_SQL}, found AS ({" UNION ALL ".join(_PASSED)}),
every AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.project_id = f.project_id AND b.extraction_id = f.extraction_id)
  UNION ALL SELECT project_id, extraction_id, 'ESQUEMA', 'E', c FROM bad)
SELECT project_id, extraction_id, rule, severity, "column", count(*) AS n FROM every GROUP BY ALL""")
def validated_rows(t: Tables) -> DataFrame:
    """All rules as one gate: an extraction with schema faults shows only those."""
    found = rules.validate(_untidy(t), codebook_columns(t), _types(t))
    return found.groupBy("project_id", "extraction_id", "rule", "severity", "column").agg(F.count("*").alias("n"))


_V = f"({' UNION ALL '.join(f'(SELECT * FROM ({s}))' for s in ROW_SQL.values())})"


@query("run_report", f"""SELECT project_id, extraction_id, count(*) FILTER (severity = 'E') AS errors, count(*) FILTER (severity = 'A') AS warnings,
  count(*) FILTER (severity = 'E') > 0 AS failed FROM {_V} GROUP BY ALL""")
def run_report(t: Tables) -> DataFrame:
    return rules.run_report(rules.row_violations(coded(t, looked_up=True)), ["project_id", "extraction_id"])


@query("rule_rollup", f"""SELECT extraction_id AS doc_id, rule, count(*) AS n FROM {_V} GROUP BY ROLLUP (extraction_id, rule)""")
def rule_rollup(t: Tables) -> DataFrame:
    return rules.rule_rollup(rules.row_violations(coded(t, looked_up=True)))


@query("parsed_reports", """WITH e AS (SELECT user_id AS run_id, event_id AS line_no, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning'
    WHEN 'purchase' THEN 'announce' WHEN 'signup' THEN 'blank' ELSE 'other' END AS k, event_type FROM events),
  a AS (SELECT run_id, min(line_no) AS stop FROM e WHERE k = 'announce' AND run_id % 3 = 0 GROUP BY run_id)
SELECT run_id, line_no, CASE WHEN k IN ('error', 'warning') THEN k ELSE 'error' END AS kind,
  CASE k WHEN 'error' THEN '[V01] fallo' WHEN 'warning' THEN '[V19] bajo' WHEN 'announce' THEN '12 líneas' ELSE 'detalle ' || event_type END AS message
FROM e LEFT JOIN a USING (run_id) WHERE k IN ('error', 'warning') OR (line_no < stop AND k <> 'blank')""")
def parsed_reports(t: Tables) -> DataFrame:
    announced = F.when(F.col("user_id") % 3 == 0, "12 errores de esquema; corrija").otherwise("12 líneas")
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", "ERROR   [V01] fallo  ").when(kind == "view", "AVISO   [V19] bajo").when(kind == "purchase", announced)
        .when(kind == "signup", "   ").otherwise(F.concat(F.lit("detalle "), kind)))
    return rules.parse_report(t.read("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line")))


@query("evidence_without_blocks", f"""WITH {CODED} SELECT project_id, extraction_id, row_pos, CAST(ev_muestra AS INT)::BIGINT + CAST(ev_r AS INT) AS evidences, 0::BIGINT AS with_block FROM coded""")
def evidence_without_blocks(t: Tables) -> DataFrame:
    bare = rules.strip_block_ids(coded(t))
    every = F.flatten(F.map_values("traz.evidencia"))
    return bare.select("project_id", "extraction_id", "row_pos", F.size(every).alias("evidences"),
                       F.size(F.filter(F.transform(every, lambda e: F.to_json(e)), lambda j: j.contains("bloque_id"))).alias("with_block"))


# ------------------------------------------------------------------ comparison
def _blind_wide(t: Tables) -> DataFrame:
    """A second coding: small and large numeric shifts, outer spaces, other categories, and some rows left out."""
    w = coded_wide(t).filter("row_pos < 4 or country <> 'Chile'")
    return w.withColumns({
        "r": F.expr("CASE WHEN items % 3 = 0 THEN r + 0.0008 WHEN items % 3 = 1 THEN r + 0.02 ELSE r END"),
        "muestra": F.expr("CASE WHEN items % 4 = 0 THEN NULL ELSE muestra END"),
        "nivel": F.expr("CASE WHEN items1 = 2 THEN ' Individual ' ELSE nivel END"),
        "design": F.expr("CASE WHEN items = 5 THEN 'Longitudinal' ELSE design END"),
        "technique": F.expr("CASE WHEN items = 2 THEN NULL ELSE technique END"),
    })


def _both(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The two codings as they are compared, with :func:`compared_values`."""
    return coded_flat(t), coded_flat(t, _blind_wide(t))


_PAIRS = f"""{CODED}, blind AS (SELECT * FROM coded WHERE row_pos < 4 OR country <> 'Chile'),
pairs AS (SELECT a.project_id, a.extraction_id, a.row_pos, a.estudio,
    CASE WHEN a.muestra IS NULL THEN TRUE ELSE a.items % 4 <> 0 END AS muestra, a.r IS NULL OR a.items % 3 <> 1 AS r,
    TRUE AS nivel, a.items <> 5 OR a.design = 'Longitudinal' AS design, a.items <> 2 OR a.technique IS NULL AS technique
  FROM coded a JOIN blind b ON b.project_id = a.project_id AND b.extraction_id = a.extraction_id AND b.row_pos = a.row_pos),
fields AS (
  SELECT project_id, extraction_id, row_pos, 'Muestra' AS field, muestra AS equal FROM pairs UNION ALL
  SELECT project_id, extraction_id, row_pos, 'Correlación Feli 1 - JP', r FROM pairs UNION ALL
  SELECT project_id, extraction_id, row_pos, 'Nivel', nivel FROM pairs UNION ALL
  SELECT project_id, extraction_id, row_pos, 'Study design', design FROM pairs UNION ALL
  SELECT project_id, extraction_id, row_pos, 'tecnica_del_beta', technique FROM pairs UNION ALL
  SELECT project_id, extraction_id, row_pos, f, TRUE FROM pairs, (SELECT unnest(['Beta Fel 1- JP', 'Fiabilidad Alfa - Omega (desempeño)',
    'Fiabilidad Alfa - Omega (felicidad)', '# Ítems', 'Items instrumento1', 'Desempeño', 'Hedónica/eudaimónica', 'Tipo de felicidad real',
    'How measure the employee perfomance', 'Analysis method (principal)', 'Direccionalidad de la relación', 'Incluir en meta análisi',
    'metodo_obtencion_r', 'tipo_de_efecto', 'tipo_fiabilidad_desempeno', 'tipo_fiabilidad_felicidad']) AS f)
  UNION ALL SELECT c.project_id, c.extraction_id, NULL, 'número de filas', c.n = coalesce(b.n, 0)
  FROM (SELECT project_id, extraction_id, count(*) AS n FROM coded GROUP BY ALL) c LEFT JOIN (SELECT project_id, extraction_id, count(*) AS n FROM blind GROUP BY ALL) b
    ON b.project_id = c.project_id AND b.extraction_id = c.extraction_id)"""


@query("compared_codings", f"WITH {_PAIRS} SELECT * FROM fields")
def compared_codings(t: Tables) -> DataFrame:
    return compare.compare_codings(*_both(t), values=compared_values()).select("project_id", "extraction_id", "row_pos", "field", "equal")


_AGREEMENT = f"""{_PAIRS}, agreed AS (SELECT project_id, extraction_id, count(*) AS total, count(*) FILTER (equal) AS hits FROM fields GROUP BY ALL)"""


@query("agreement", f"WITH {_AGREEMENT} SELECT project_id, extraction_id, total, hits, CAST(round_even(hits / total, 3) AS DOUBLE) AS agreement FROM agreed")
def agreement(t: Tables) -> DataFrame:
    return compare.agreement_of(*_both(t), values=compared_values())


@query("low_agreement", f"""WITH {_AGREEMENT} SELECT project_id, extraction_id, total, hits FROM agreed WHERE round(hits / total, 3) < 0.95""")
def low_agreement(t: Tables) -> DataFrame:
    low = compare.low_agreement(compare.agreement_of(*_both(t), values=compared_values()), 0.95)
    return low.filter(F.col("notice").startswith("Acuerdo extractor-codificador ciego de 0.")).select("project_id", "extraction_id", "total", "hits")


@query("gold_comparison", f"""WITH {CODED} SELECT project_id, extraction_id, 1 + 21 * count(*) AS total, 1 + 21 * count(*) AS hits, CAST(1 AS DOUBLE) AS agreement FROM coded GROUP BY ALL""")
def gold_comparison(t: Tables) -> DataFrame:
    """A coding against itself as the verified example."""
    return compare.gold_comparison(coded_flat(t), coded_flat(t), compared_values())


_EQUALITY_SQL = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS a, l_discount + (l_linenumber % 3) * 0.0008 AS b FROM lineitem)
SELECT l_linenumber, count(*) FILTER (abs(a - b) <= 0.001) AS equal, count(*) FILTER (NOT abs(a - b) <= 0.001) AS different FROM p GROUP BY ALL"""


@query("typed_equality", _EQUALITY_SQL)
def typed_equality(t: Tables) -> DataFrame:
    from quoteloom.functions.typed import cells_equal

    a, b = float_cell(F.col("l_discount")), float_cell(F.col("l_discount") + (F.col("l_linenumber") % 3) * 0.0008)
    pairs = t.read("lineitem").select("l_linenumber", cells_equal(a, b).alias("equal"))
    return pairs.groupBy("l_linenumber").agg(F.count_if("equal").alias("equal"), F.count_if(~F.col("equal")).alias("different"))


_MATRICES = """a AS (SELECT CAST(o_custkey AS STRING) AS doc_id, o_orderkey AS row_no, unnest([1, 2, 3]) AS position,
    unnest([o_orderstatus, o_orderpriority, CAST(o_totalprice AS STRING)]) AS value FROM orders),
b AS (SELECT doc_id, row_no, position, CASE WHEN row_no % 5 = 0 THEN 'No indica' WHEN row_no % 5 = 1 THEN lower(value) WHEN row_no % 5 = 2 THEN replace(value, '.', ',')
    WHEN row_no % 5 = 3 THEN value || 'x' ELSE value END AS value FROM a WHERE NOT (row_no % 7 = 0 AND position = 2)),
classed AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.row_no, b.row_no) AS row_no, coalesce(a.position, b.position) AS position,
  CASE WHEN a.value IS NOT DISTINCT FROM b.value THEN 'identical' WHEN coalesce(a.value, '') IN ('', 'No indica') THEN 'missing in a'
    WHEN coalesce(b.value, '') IN ('', 'No indica') THEN 'missing in b' WHEN lower(a.value) = lower(replace(b.value, ',', '.')) THEN 'equivalent' ELSE 'different' END AS class
  FROM a FULL JOIN b ON b.doc_id = a.doc_id AND b.row_no = a.row_no AND b.position = a.position)"""


def _classes(t: Tables) -> DataFrame:
    o = t.read("orders")
    entries = F.array(*[F.struct(F.lit(i).alias("position"), v.cast("string").alias("value")) for i, v in enumerate(
        (F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")), 1)])
    a = o.select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("row_no"), F.explode(entries).alias("e")).select("doc_id", "row_no", "e.*")
    way = F.col("row_no") % 5
    b = a.filter(~((F.col("row_no") % 7 == 0) & (F.col("position") == 2))).withColumn("value", (
        F.when(way == 0, "No indica").when(way == 1, F.lower("value")).when(way == 2, F.replace("value", F.lit("."), F.lit(",")))
        .when(way == 3, F.concat("value", F.lit("x"))).otherwise(F.col("value"))))
    return compare.congruence(a, b)


@query("congruence_cells", f"WITH {_MATRICES} SELECT * FROM classed")
def congruence_cells(t: Tables) -> DataFrame:
    return _classes(t)


@query("congruence_report", f"""WITH {_MATRICES}, counted AS (SELECT CASE WHEN grouping(doc_id) = 0 THEN 'document' WHEN grouping(position) = 0 THEN 'column' ELSE 'all' END AS scope,
    doc_id, position, class, count(*) AS n FROM classed GROUP BY GROUPING SETS ((class), (doc_id, class), (position, class)))
SELECT scope, doc_id, position, class, n, CAST(round_even(100.0 * n / sum(n) OVER (PARTITION BY scope, doc_id, position), 1) AS DOUBLE) AS pct FROM counted""")
def congruence_report(t: Tables) -> DataFrame:
    return compare.shares(compare.congruence_report(_classes(t)))


# ------------------------------------------------------------------ reconciliation
@query("verdicts", """SELECT event_id, CASE event_type WHEN 'click' THEN 'REFUTADO' WHEN 'view' THEN 'CONFIRMADO' ELSE 'NO_VERIFICABLE' END AS verdict FROM events""")
def verdicts(t: Tables) -> DataFrame:
    said = (F.when(F.col("event_type") == "click", " Refutado: otra tabla").when(F.col("event_type") == "view", "confirmado")
            .when(F.col("event_type") == "error", "no verificable").when(F.col("event_type") == "signup", "quizá"))
    return t.read("events").select("event_id", reconcile.verdict(said).alias("verdict"))


def _audit(t: Tables) -> DataFrame:
    """One finding of the evidence auditor per coded row, on its own study or without one."""
    w = coded_wide(t)
    return w.select(
        "project_id", "extraction_id", F.col("row_pos").alias("item_no"), F.expr("CASE WHEN items1 <> 4 THEN estudio END").alias("study"),
        F.expr("CASE WHEN items1 = 3 THEN 'Rara' ELSE 'Muestra' END").alias("column"),
        F.expr("CASE items1 WHEN 0 THEN 'Confirmado' WHEN 1 THEN 'REFUTADO: no' WHEN 3 THEN 'refutado' ELSE 'No verificable' END").alias("verdict"),
        F.lit("revise").alias("finding"), F.col("quote_muestra").alias("evidence"))


_FINDINGS = f"""{_PAIRS}, findings AS (
  SELECT project_id, extraction_id, 'A|' || row_pos AS finding_id, CASE WHEN items1 <> 4 THEN estudio END AS study,
    CASE WHEN items1 = 3 THEN 'Rara' ELSE 'Muestra' END AS "column", 'AUDITOR_EVIDENCIA' AS auditor,
    CASE WHEN items1 IN (1, 3) THEN 'REFUTADO' ELSE 'NO_VERIFICABLE' END AS verdict FROM coded WHERE items1 <> 0
  UNION ALL SELECT f.project_id, f.extraction_id, 'B|' || coalesce(CAST(f.row_pos AS STRING), '') || '|' || field, c.estudio, field, 'CODIFICADOR_CIEGO', 'REFUTADO'
  FROM fields f LEFT JOIN coded c ON c.project_id = f.project_id AND c.extraction_id = f.extraction_id AND c.row_pos = f.row_pos WHERE NOT equal)"""


def _findings(t: Tables) -> DataFrame:
    a, b = _both(t)
    return reconcile.findings_table(_audit(t), compare.compare_codings(a, b, proofs=True, values=compared_values()), b)


@query("findings_table", f"WITH {_FINDINGS} SELECT * FROM findings")
def findings_table(t: Tables) -> DataFrame:
    return _findings(t).select("project_id", "extraction_id", "finding_id", "study", "column", "auditor", "verdict")


_POINTS = f"""{_FINDINGS}, located AS (SELECT project_id, extraction_id, estudio, min(row_pos) AS p FROM coded GROUP BY ALL),
single AS (SELECT project_id, extraction_id, min(row_pos) AS p FROM coded GROUP BY ALL HAVING count(*) = 1),
points AS (SELECT f.*, CASE WHEN auditor = 'CODIFICADOR_CIEGO' THEN TRY_CAST(split_part(finding_id, '|', 2) AS BIGINT) ELSE coalesce(l.p, s.p) END AS row_pos
  FROM findings f LEFT JOIN located l ON l.project_id = f.project_id AND l.extraction_id = f.extraction_id AND l.estudio = f.study
  LEFT JOIN single s ON s.project_id = f.project_id AND s.extraction_id = f.extraction_id WHERE verdict = 'REFUTADO')"""


@query("decision_points", f"""WITH {_POINTS} SELECT project_id, extraction_id, finding_id, row_pos, "column",
  CASE auditor WHEN 'CODIFICADOR_CIEGO' THEN 'Codificador ciego' ELSE 'Auditor de evidencia' END AS source FROM points""")
def decision_points(t: Tables) -> DataFrame:
    return reconcile.decision_points(_findings(t), coded(t)).select("project_id", "extraction_id", "finding_id", "row_pos", "column", "source")


def _decided(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coded rows, their findings and judged decisions. Each article has one block that holds the number of its order."""
    rows = cut_lineage(coded(t))
    findings = cut_lineage(_findings(t))
    points = reconcile.decision_points(findings, rows)
    text = F.concat(F.lit("the order number is "), F.col("extraction_id"), F.lit(" in this text"))
    blocks = rows.select("project_id", "extraction_id").distinct().select(
        "project_id", F.col("extraction_id").alias("doc_id"), F.lit(0).alias("pos"), F.lit(1).alias("page"), F.lit(1).alias("ord"), F.lit("p01-b01").alias("block_id"),
        F.lit("parrafo").alias("type"), F.expr("named_struct('x0', 1D, 'y0', 1D, 'x1', 2D, 'y1', 2D)").alias("rect"), text.alias("text"), text.alias("text_norm"),
        F.lit(False).alias("is_table"), F.lit(False).alias("is_image"), F.lit(None).cast("array<struct<row:int,col:int,text:string,row_label:string,col_label:string>>").alias("cells"),
        text.alias("effective_norm"))
    way = F.coalesce(F.col("row_pos"), F.lit(0)) % 4
    decisions = points.select(
        "project_id", "extraction_id", "finding_id",
        F.when(way == 0, "VALOR_EXTRACTOR").when(way == 1, "valor_alternativo").when(way == 2, "OTRO").alias("decision"),
        (F.col("column") != "Study design").alias("has_value"), int_cell(F.lit(99)).cast(CELL_TYPE).alias("value"), F.lit("p01-b01").alias("block_id"),
        F.when(way == 1, F.concat(F.lit("number is "), F.col("extraction_id"))).otherwise("zzz qqq").alias("quote"), F.lit("porque sí").alias("reasoning"))
    return rows, findings, cut_lineage(reconcile.judged_decisions(points, decisions, rows, blocks))


_OUTCOMES = f"""{_POINTS}, outcomes AS (SELECT p.*, CASE
    WHEN coalesce(row_pos, 0) % 4 = 0 THEN 'kept'
    WHEN coalesce(row_pos, 0) % 4 = 1 AND "column" NOT IN ('número de filas', 'Study design', 'Rara') THEN 'changed' ELSE 'pending' END AS outcome,
  CASE WHEN coalesce(row_pos, 0) % 4 NOT IN (1, 2) THEN NULL WHEN "column" = 'número de filas' OR row_pos IS NULL THEN 'El conciliador no puede abrir ni cerrar filas'
    WHEN "column" = 'Study design' THEN 'La decisión no trae valor' WHEN "column" = 'Rara' THEN 'Campo desconocido: Rara'
    WHEN coalesce(row_pos, 0) % 4 = 2 THEN 'La cita del conciliador no se encontró en el artículo' END AS refusal FROM points p)"""


@query("judged_decisions", f"WITH {_OUTCOMES} SELECT project_id, extraction_id, finding_id, outcome, refusal FROM outcomes")
def judged_decisions(t: Tables) -> DataFrame:
    return _decided(t)[2].select("project_id", "extraction_id", "finding_id", "outcome", "refusal")


@query("reconciled_rows", f"""WITH {_OUTCOMES}, hit AS (SELECT project_id, extraction_id, row_pos, bool_or("column" = 'Muestra') AS m, bool_or("column" = 'Correlación Feli 1 - JP') AS r,
    bool_or("column" = 'tecnica_del_beta') AS b FROM outcomes WHERE outcome = 'changed' GROUP BY ALL)
SELECT c.project_id, c.extraction_id, c.row_pos, CASE WHEN coalesce(h.m, FALSE) THEN '99' WHEN c.muestra IS NULL THEN 'null' ELSE CAST(c.muestra AS STRING) END AS muestra,
  coalesce(h.r, FALSE) AS r_changed, CASE WHEN coalesce(h.b, FALSE) THEN '99' ELSE c.technique END AS technique
FROM coded c LEFT JOIN hit h ON h.project_id = c.project_id AND h.extraction_id = c.extraction_id AND h.row_pos = c.row_pos""")
def reconciled_rows(t: Tables) -> DataFrame:
    rows, _, judged = _decided(t)
    new = reconcile.apply_decisions(rows, judged)
    return new.select("project_id", "extraction_id", "row_pos", cell_json(F.col("fila")["Muestra"]).alias("muestra"),
                      F.coalesce(F.col("fila")["Correlación Feli 1 - JP"]["num"] == 99, F.lit(False)).alias("r_changed"), F.col("traz.tecnica_del_beta").alias("technique"))


@query("reconciled_gate", f"""WITH {_OUTCOMES}, changed AS (SELECT DISTINCT project_id, extraction_id FROM outcomes WHERE outcome = 'changed'),
bad AS (SELECT DISTINCT project_id, extraction_id FROM coded WHERE cita = 'sin formato')
SELECT c.project_id, c.extraction_id, b.extraction_id IS NULL AS applied FROM changed c LEFT JOIN bad b ON b.project_id = c.project_id AND b.extraction_id = c.extraction_id""")
def reconciled_gate(t: Tables) -> DataFrame:
    """The gate with one rule as re-validation: no citation out of format."""
    rows, _, judged = _decided(t)
    new = reconcile.apply_decisions(rows, judged)
    violations = rules.row_violations(new, ["V03"]).filter("message like 'Cita con formato%'")
    return reconcile.gate(rows, new, judged, violations)[1]


@query("settled_findings", f"""WITH {_OUTCOMES} SELECT auditor, state, count(*) AS n FROM (
  SELECT f.auditor, CASE WHEN o.outcome IN ('kept', 'changed') THEN 'RESUELTO' ELSE 'PENDIENTE' END AS state FROM findings f
  LEFT JOIN outcomes o ON o.project_id = f.project_id AND o.extraction_id = f.extraction_id AND o.finding_id = f.finding_id
  UNION ALL SELECT 'CONCILIADOR', 'PENDIENTE' FROM outcomes WHERE outcome = 'pending') GROUP BY ALL""")
def settled_findings(t: Tables) -> DataFrame:
    rows, findings, judged = _decided(t)
    stood = judged.select("project_id", "extraction_id").distinct().withColumn("applied", F.lit(True))
    return reconcile.settled_findings(findings, judged, stood).groupBy("auditor", "state").agg(F.count("*").alias("n"))


@query("attempt_status", """WITH last AS (SELECT user_id, count(*) AS iterations, arg_max(CAST(floor(value) AS INT) % 3, event_id) AS errors FROM events GROUP BY user_id)
SELECT 'p' AS project_id, CAST(user_id AS STRING) AS extraction_id, iterations, errors::BIGINT AS errors,
  CASE WHEN errors = 0 THEN 'valid' WHEN iterations >= 70 THEN 'FALLIDA' ELSE 'retry' END AS status FROM last""")
def attempt_status(t: Tables) -> DataFrame:
    """Runs of the validator from the events of each user, with their running number."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    errors = F.slice(F.array(F.lit("[V01] a"), F.lit("[V02] b")), 1, F.col("value").cast("int") % 3)
    runs = t.read("events").select(F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("extraction_id"), n.alias("iteration"), errors.alias("errors"))
    return reconcile.attempt_status(runs, 70).select("project_id", "extraction_id", "iterations", "errors", "status")


@query("coder_routing", f"""WITH {BLOCKS}, shape AS (SELECT project_id, doc_id, count(*) FILTER (is_image) AS images, count(*) FILTER (is_table) AS tables,
    sum(length('[' || block_id || ' | ' || type || '] ' || trim(replace(text, chr(10), ' ')))) + count(*) - 1 AS chars FROM blocks GROUP BY ALL)
SELECT project_id, doc_id, CASE WHEN images > 0 THEN 'especializado' WHEN tables > 4 THEN 'especializado' ELSE 'ligero' END AS level,
  CASE WHEN images > 0 THEN 'tablas o figuras en imagen' WHEN tables > 4 THEN 'más de 4 tablas' ELSE 'artículo sin señales de complejidad' END AS reason FROM shape""")
def coder_routing(t: Tables) -> DataFrame:
    from quoteloom.operators.documents import labelled_lines

    b = shown_blocks(t)
    return reconcile.route_blind_coder(b, labelled_lines(b))


@query("escalated_coding", f"""WITH {_AGREEMENT} SELECT b.project_id, b.extraction_id, count(*) AS "rows",
  CASE WHEN round(hits / total, 3) >= 0.95 THEN 'ligero' ELSE 'especializado' END AS coder_level
FROM (SELECT project_id, extraction_id, CASE WHEN FALSE THEN 1 END AS x FROM coded) b JOIN agreed a ON a.project_id = b.project_id AND a.extraction_id = b.extraction_id
WHERE round(hits / total, 3) < 0.95 GROUP BY ALL
UNION ALL SELECT b.project_id, b.extraction_id, count(*), 'ligero' FROM blind b JOIN agreed a ON a.project_id = b.project_id AND a.extraction_id = b.extraction_id
WHERE round(hits / total, 3) >= 0.95 GROUP BY b.project_id, b.extraction_id""")
def escalated_coding(t: Tables) -> DataFrame:
    rows, light = coded_flat(t), coded_flat(t, _blind_wide(t))
    chosen = reconcile.escalate(light, rows, compare.agreement_of(*_both(t), values=compared_values()), 0.95)
    return chosen.groupBy("project_id", "extraction_id", "coder_level").agg(F.count("*").alias("rows"))


@query("audit_rows", f"""WITH {_FINDINGS} SELECT project_id, extraction_id, study, "column", CASE auditor WHEN 'AUDITOR_EVIDENCIA' THEN 'Auditor de evidencia' ELSE 'Codificador ciego' END AS auditor,
  replace(verdict, '_', ' ') AS verdict, 'Pendiente' AS state FROM findings""")
def audit_rows(t: Tables) -> DataFrame:
    return reconcile.audit_rows(_findings(t)).select("project_id", "extraction_id", "study", "column", "auditor", "verdict", "state")


# ------------------------------------------------------------------ coded output as JSON
@query("coded_output_json", f"""WITH {CODED} SELECT project_id, extraction_id, row_pos, 'int' AS study_kind, CASE WHEN muestra IS NULL THEN 'null' ELSE CAST(muestra AS STRING) END AS muestra,
  CASE WHEN r IS NULL THEN 'null' ELSE 'float' END AS r_kind, via FROM coded""")
def coded_output_json(t: Tables) -> DataFrame:
    """Rows written as coded output and read back."""
    w = coded_wide(t)
    item = F.to_json(F.struct(F.struct(F.col("estudio").alias("Estudio"), F.col("muestra").alias("Muestra"), F.col("r").alias("r")).alias("fila"),
                              F.struct(F.col("via").alias("via_de_identificacion")).alias("trazabilidad")), {"ignoreNullFields": "false"})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_pos", item.alias("j")))), lambda x: x["j"])
    outputs = w.groupBy("project_id", "extraction_id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("content")).withColumn("doc_id", F.col("extraction_id"))
    rows = coded_rows(outputs)
    return rows.select("project_id", "extraction_id", "row_pos", F.col("fila")["Estudio"]["kind"].alias("study_kind"), cell_json(F.col("fila")["Muestra"]).alias("muestra"),
                       F.col("fila")["r"]["kind"].alias("r_kind"), F.col("traz.via_de_identificacion").alias("via"))


@query("coded_evidence", f"""WITH {CODED} SELECT project_id, extraction_id, row_pos, estudio AS study, 'Muestra' AS "column", quote_muestra AS quote FROM coded WHERE ev_muestra
UNION ALL SELECT project_id, extraction_id, row_pos, estudio, 'Correlación Feli 1 - JP', quote_muestra FROM coded WHERE ev_r""")
def coded_evidence(t: Tables) -> DataFrame:
    return evidence_of(coded(t)).select("project_id", "extraction_id", "row_pos", "study", "column", "quote")


@query("extraction_summary", f"""WITH {_FINDINGS}, agreed AS (SELECT project_id, extraction_id, CAST(round_even(count(*) FILTER (equal) / count(*), 3) AS DOUBLE) AS agreement FROM fields GROUP BY ALL),
p AS (SELECT project_id, extraction_id, count(*) AS pending FROM findings GROUP BY ALL),
er AS (SELECT project_id, extraction_id, count(*) AS errors FROM coded WHERE muestra IS NULL AND include <> 'No' GROUP BY ALL),
x AS (SELECT project_id, extraction_id, bool_or(CAST(extraction_id AS BIGINT) % 2 = 0) AS done, count(*) AS n, string_agg(DISTINCT CAST(estudio AS STRING), ',' ORDER BY CAST(estudio AS STRING)) AS studies FROM coded GROUP BY project_id, extraction_id)
SELECT x.project_id, x.extraction_id, CASE WHEN done THEN 'COMPLETADA' ELSE 'FALLIDA' END AS state, CASE WHEN done THEN studies ELSE '' END AS studies, agreement, n AS verified,
  coalesce(pending, 0) AS pending, coalesce(errors, 0) AS errors, CAST(n * 0.5 AS DOUBLE) AS cost_usd
FROM x LEFT JOIN agreed a ON a.project_id = x.project_id AND a.extraction_id = x.extraction_id LEFT JOIN p ON p.project_id = x.project_id AND p.extraction_id = x.extraction_id
  LEFT JOIN er ON er.project_id = x.project_id AND er.extraction_id = x.extraction_id""")
def extraction_summary(t: Tables) -> DataFrame:
    """Every order as an extraction; one verified anchor and half a dollar per coded row."""
    rows = coded(t)
    ext = ["project_id", "extraction_id"]
    done = F.when(F.col("extraction_id").cast("bigint") % 2 == 0, "COMPLETADA").otherwise("FALLIDA")
    extractions = rows.select(*ext).distinct().withColumn("state", done)
    anchors = rows.select(*ext, F.lit("VERIFICADA").alias("level"))
    use = rows.select(*ext, F.lit(0.5).alias("cost_usd"))
    agreed = compare.agreement_of(*_both(t), values=compared_values())
    out = reconcile.extraction_summary(extractions, rows, anchors, agreed, _findings(t), rules.row_violations(coded(t, looked_up=True), ["V09"]), use)
    return out.select(*ext, "state", F.array_join("studies", ",").alias("studies"), "agreement", F.col("VERIFICADA").alias("verified"), "pending", "errors", "cost_usd")
