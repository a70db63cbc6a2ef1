"""Inputs of the operators derived from the benchmark tables, each next to the SQL that derives the same rows.

Expressions that both engines read alike are written once, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import words_of
from quoteloom.functions.typed import CELL_TYPE, float_cell, int_cell, null_cell, text_cell
from quoteloom.operators.documents import blocks_from_items, effective_blocks
from quoteloom.plans.registry import Tables
from quoteloom.schemas import EVIDENCE as EVIDENCE_TYPE
from quoteloom.schemas import TRACE_FIELDS
from quoteloom.session import cut_lineage
from quoteloom.vocab import CRITICAL_ROW_FIELDS, CRITICAL_TRACE_FIELDS, STUDY

# kinds given to the lines of a document by their place, to exercise every kind of item
ITEM_KINDS = ["text", "text", "text", "list", "table", "image", "chart", "equation", "interline_equation", "page_footnote",
              "header", "footer", "page_number", "aside_text", "code", "ref_text", "stamp"]


def sql_norm(x: str) -> str:
    """norm() for texts whose compatibility form is themselves, as all benchmark texts are."""
    plain = f"replace(translate({x}, '’‘“”–—', '''''\"\"--'), '-' || chr(10), '')"
    return f"lower(trim(regexp_replace({plain}, '\\s+', ' ', 'g')))"


# ------------------------------------------------------------------ documents → items, pages, blocks
def items(t: Tables) -> DataFrame:
    """Each line of a document as a converter item; four lines make a page. The language is the project."""
    lines = t.documents.select(
        F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kind = F.get(F.array(*map(F.lit, ITEM_KINDS)), F.col("pos") % len(ITEM_KINDS))
    row = F.concat(
        F.lit("<tr><td>"),
        F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(" "), F.lit("</td><td>")),
        F.lit("</td></tr>"))
    left, top = 50.0 + 10.0 * (F.col("pos") % 7), 100.0 + 200.0 * (F.col("pos") % 4)
    return lines.withColumn("type", kind).select(
        "project_id", "doc_id", "pos", F.floor(F.col("pos") / 4).cast("int").alias("page_idx"), "type",
        F.when(F.col("pos") == 0, 1).alias("text_level"),
        F.when(F.col("line") != "", F.array(left, top, F.lit(950.0), top + 150.0)).alias("bbox"),
        F.when(~F.col("type").isin("equation", "interline_equation"), F.col("line")).alias("text"),
        F.when(F.col("type").isin("equation", "interline_equation"), F.col("line")).alias("content"),
        F.when(F.col("type") == "list", F.split("line", ", ")).alias("list_items"),
        F.when(F.col("type") == "table", F.concat(F.lit("<table>"), row, row, F.lit("</table>"))).alias("table_body"),
        F.when(F.col("type") == "table", F.array(F.lit("Table"))).alias("table_caption"),
        F.when(F.col("type") == "table", F.array(F.lit(""))).alias("table_footnote"),
        F.when(F.col("type") == "image", F.array("line")).alias("image_caption"),
        F.lit(None).cast("array<string>").alias("image_footnote"),
        F.when(F.col("type") == "chart", F.array(F.lit("Chart"))).alias("chart_caption"),
        F.when(F.col("type") == "chart", F.array("line")).alias("chart_footnote"),
        F.lit(None).cast("string").alias("img_path"),
        "line",
    )


def pages(t: Tables, its: DataFrame | None = None) -> DataFrame:
    """Pages with more than 30 characters; shorter ones are unknown to the converter."""
    its = items(t) if its is None else its
    size = its.groupBy("project_id", "doc_id", "page_idx").agg(F.sum(F.char_length("line")).alias("_n")).filter("_n > 30")
    return size.select(
        "project_id", "doc_id", (F.col("page_idx") + 1).alias("page"), (595.0 + 10.0 * (F.col("page_idx") % 3)).alias("width_pt"),
        F.lit(842.0).alias("height_pt"))


def blocks(t: Tables) -> DataFrame:
    its = items(t)
    return blocks_from_items(its.drop("line"), pages(t, its))


def shown_blocks(t: Tables) -> DataFrame:
    return effective_blocks(blocks(t))


def stored_blocks(t: Tables) -> DataFrame:
    """Blocks as a stored table, which is what the anchoring steps read several times."""
    return cut_lineage(shown_blocks(t))


_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in ITEM_KINDS) + f"][1 + pos % {len(ITEM_KINDS)}]"
ITEMS = f"""
lines AS (
  SELECT lang AS project_id, CAST(doc_id AS VARCHAR) AS doc_id, parts, unnest(range(0, len(parts))) AS pos
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)
), items AS (
  SELECT project_id, doc_id, pos, pos // 4 AS page_idx, {_KIND_SQL} AS kind, parts[pos + 1] AS line FROM lines
), pages AS (
  SELECT project_id, doc_id, page_idx + 1 AS page, 595.0 + 10.0 * (page_idx % 3) AS width_pt FROM items
  GROUP BY ALL HAVING sum(length(line)) > 30
)"""
BLOCKS = f"""{ITEMS}, numbered AS (
  SELECT i.*, i.page_idx + 1 AS page, width_pt, row_number() OVER (PARTITION BY i.project_id, i.doc_id, i.page_idx ORDER BY pos) AS ord
  FROM items i JOIN pages p ON p.project_id = i.project_id AND p.doc_id = i.doc_id AND p.page = i.page_idx + 1
  WHERE line <> ''
), raw_blocks AS (
  SELECT project_id, doc_id, pos, page, ord, printf('p%02d-b%02d', page, ord) AS block_id, kind, width_pt,
    CASE WHEN kind = 'text' THEN CASE WHEN pos = 0 THEN 'titulo' ELSE 'parrafo' END WHEN kind = 'table' THEN 'tabla'
      WHEN kind IN ('image', 'chart') THEN 'figura' WHEN kind IN ('equation', 'interline_equation') THEN 'ecuacion'
      WHEN kind = 'page_footnote' THEN 'nota' WHEN kind IN ('code', 'list', 'ref_text') THEN 'parrafo' ELSE 'otro' END AS type,
    CASE kind WHEN 'table' THEN 'Table' || chr(10) || line || chr(10) || line WHEN 'list' THEN replace(line, ', ', chr(10))
      WHEN 'chart' THEN 'Chart' || chr(10) || line ELSE line END AS text, line
  FROM numbered
), blocks AS (
  SELECT *, {sql_norm('text')} AS text_norm, type = 'tabla' AS is_table, type = 'figura' AS is_image FROM raw_blocks
)"""


# ------------------------------------------------------------------ evidence: one quote per block
def evidence(t: Tables, blks: DataFrame) -> DataFrame:
    """A quote from each block: as it is, cited in the next block of the page, with letters lost, or reversed."""
    words = words_of("text_norm")
    cut = F.when(F.size(words) >= 6, F.array_join(F.slice(words, 3, 6), " ")).otherwise(F.col("text_norm"))
    way = F.col("pos") % 4
    quote = F.when(way == 2, F.replace(cut, F.lit("e"), F.lit(""))).when(way == 3, F.reverse(cut)).otherwise(cut)
    cited = (
        F.when(way == 1, F.format_string("p%02d-b%02d", F.col("page"), F.col("ord") % 4 + 1))
        .when(way == 3, "p99-b99").otherwise(F.col("block_id"))
    )
    return blks.select(
        "project_id", F.col("doc_id").alias("extraction_id"), "doc_id", F.col("pos").alias("row_pos"), F.col("doc_id").cast("bigint").alias("study"),
        F.lit("Muestra").alias("column"), F.lit(0).alias("ev_idx"), F.col("page").alias("page_hint"), quote.alias("quote"),
        F.lit(None).cast("string").alias("table_row"), F.lit(None).cast("string").alias("table_col"), F.col("is_image").alias("figure"),
        cited.alias("block_id"))


EVIDENCE = f"""{BLOCKS}, cuts AS (
  SELECT *, CASE WHEN len(string_split(text_norm, ' ')) >= 6 THEN array_to_string(string_split(text_norm, ' ')[3:8], ' ') ELSE text_norm END AS cut
  FROM blocks
), evidence AS (
  SELECT project_id, doc_id, pos AS row_pos, page, is_image AS figure,
    {sql_norm("CASE pos % 4 WHEN 2 THEN replace(cut, 'e', '') WHEN 3 THEN reverse(cut) ELSE cut END")} AS q,
    CASE pos % 4 WHEN 1 THEN printf('p%02d-b%02d', page, ord % 4 + 1) WHEN 3 THEN 'p99-b99' ELSE block_id END AS cited
  FROM cuts
), variants AS (
  SELECT project_id, doc_id, block_id, pos, page, text_norm AS t FROM blocks
), own AS (
  SELECT e.project_id, e.doc_id, e.row_pos, v.block_id, v.page, strpos(v.t, e.q) - 1 AS start
  FROM evidence e JOIN variants v ON v.project_id = e.project_id AND v.doc_id = e.doc_id AND v.block_id = e.cited
  WHERE e.q <> '' AND contains(v.t, e.q)
), other AS (
  SELECT e.project_id, e.doc_id, e.row_pos, arg_min(v.block_id, v.pos) AS block_id, arg_min(v.page, v.pos) AS page,
    arg_min(strpos(v.t, e.q) - 1, v.pos) AS start
  FROM evidence e ANTI JOIN own o ON o.project_id = e.project_id AND o.doc_id = e.doc_id AND o.row_pos = e.row_pos
  JOIN variants v ON v.project_id = e.project_id AND v.doc_id = e.doc_id
  WHERE e.q <> '' AND contains(v.t, e.q) GROUP BY ALL
), literal AS (
  SELECT e.project_id, e.doc_id, e.row_pos, e.q, e.cited, e.figure,
    CASE WHEN o.block_id IS NOT NULL THEN 'VERIFICADA' WHEN x.block_id IS NOT NULL THEN 'VERIFICADA_CON_CORRECCION' END AS level,
    coalesce(o.block_id, x.block_id) AS block_id, coalesce(o.page, x.page) AS page, coalesce(o.start, x.start) AS start
  FROM evidence e
  LEFT JOIN own o ON o.project_id = e.project_id AND o.doc_id = e.doc_id AND o.row_pos = e.row_pos
  LEFT JOIN other x ON x.project_id = e.project_id AND x.doc_id = e.doc_id AND x.row_pos = e.row_pos
)"""


# ------------------------------------------------------------------ coded rows from lineitem
# alias: expression both engines read; the order is that of the select list, later ones may not use earlier ones
_YEAR = "CAST(year(l_shipdate) AS STRING)"
_R = "CASE WHEN l_suppkey % 3 <> 0 THEN round(l_discount * 10 - 0.3, 2) END"
# a coefficient under a thousandth here and there
_TINY = "l_returnflag <> 'R' AND l_partkey % 29 = 0"
_BETA = f"CASE WHEN {_TINY} THEN 0.0005 WHEN l_returnflag <> 'R' THEN round(l_tax * 20 - 0.3, 2) END"
CODED_EXPR = {
    "estudio": "l_linenumber",
    "documento": "l_orderkey * 2 + l_linenumber % 2",
    "author": "CASE l_returnflag WHEN 'A' THEN 'Ana Lopez' WHEN 'N' THEN 'Luis Ruiz; Eva Diaz' ELSE 'Amar Singh; Ben Roy; Cy Das' END",
    "anio": "year(l_shipdate)",
    "cita": f"""CASE WHEN l_partkey % 10 = 0 THEN 'sin formato' WHEN l_partkey % 10 = 1 THEN 'Otro (' || {_YEAR} || ')'
        WHEN l_partkey % 10 = 2 THEN 'Lopez (1900)' WHEN l_returnflag = 'A' THEN 'LOPEZ (' || {_YEAR} || ')'
        WHEN l_returnflag = 'N' THEN 'Ruiz y Diaz (' || {_YEAR} || 'b)' ELSE 'Singh et al. (' || {_YEAR} || ')' END""",
    "muestra": "CASE WHEN l_quantity > 3 THEN CAST(l_quantity AS INT) END",
    "r": _R,
    "beta": _BETA,
    "transcript": f"""CASE WHEN l_partkey % 4 = 0 THEN 'sin datos' ELSE 'r = ' || replace(CAST(coalesce({_R}, 0.5) AS STRING), '.', ',')
        || ' y beta = ' || CASE WHEN {_TINY} THEN '0.0005' ELSE CAST(coalesce({_BETA}, 0.1) AS STRING) END END""",
    "items": "l_linenumber",
    "items1": "l_suppkey % 5",
    "rel_p": "CASE WHEN l_partkey % 5 <> 0 THEN round(0.6 + l_discount * 3, 2) END",
    "rel_h": "CASE WHEN l_partkey % 6 <> 0 THEN round(0.65 + l_tax * 2, 2) END",
    "covidence": "CASE WHEN l_partkey % 8 <> 0 THEN l_suppkey END",
    "nivel": "CASE l_suppkey % 5 WHEN 0 THEN 'Group' WHEN 1 THEN 'Multinivel' ELSE 'Individual' END",
    "design": "CASE l_partkey % 3 WHEN 0 THEN 'Cross sectional study' WHEN 1 THEN 'Randomised controlled trial' ELSE 'Longitudinal' END",
    "include": """CASE l_partkey % 7 WHEN 0 THEN 'No' WHEN 1 THEN 'SI' WHEN 2 THEN 'PLS' WHEN 3 THEN 'SEM latente' WHEN 4 THEN 'Multinivel'
        WHEN 5 THEN 'Experimental' ELSE 'Organizacional' END""",
    "direction": "CASE l_linenumber % 3 WHEN 0 THEN 'HP' WHEN 1 THEN 'Relación negativa' ELSE 'PH' END",
    "valid": "CASE l_linenumber % 2 WHEN 0 THEN 'Si' ELSE 'No' END",
    "scales": "CASE l_suppkey % 3 WHEN 0 THEN 'No indica' WHEN 1 THEN 'AFC de la escala' ELSE 'solo alfa' END",
    "valid_cfa": "CASE l_partkey % 2 WHEN 0 THEN 'Si' ELSE 'No' END",
    "cfa": "CASE l_partkey % 5 WHEN 0 THEN 'Si' ELSE 'No' END",
    "start_date": "CASE WHEN l_partkey % 9 = 0 THEN 'No indica' ELSE substr(CAST(l_shipdate AS STRING), 1, 7) END",
    "end_date": "CASE WHEN l_partkey % 6 = 0 THEN 'No indica' ELSE CAST(year(l_shipdate) + l_linenumber % 3 - 1 AS STRING) END",
    "conclusion": "CASE l_linenumber % 4 WHEN 0 THEN 'La felicidad CAUSA desempeño' WHEN 1 THEN 'pendiente de revisar' ELSE 'se asocian' END",
    "happiness": "CASE l_suppkey % 4 WHEN 0 THEN 'Satisfacción laboral' WHEN 1 THEN 'Orientación hedónica' WHEN 2 THEN 'Bienestar' ELSE 'Compromiso' END",
    "family": "CASE l_partkey % 2 WHEN 0 THEN 'Hedónica' ELSE 'Eudaimónica' END",
    "country": "CASE l_returnflag WHEN 'A' THEN 'China' WHEN 'N' THEN 'India' ELSE 'Chile' END",
    "population": "l_linestatus",
    # trace
    "sample": "CAST(l_suppkey AS STRING)",
    "via": "CASE l_linenumber % 2 WHEN 0 THEN 'Covidence' ELSE 'Otros métodos' END",
    "st_muestra": "CASE WHEN l_partkey % 2 = 0 THEN 'No indica' END",
    "st_r": "CASE WHEN l_partkey % 3 = 0 THEN 'No indica (no significativo)' END",
    "st_rel_p": "CASE WHEN l_partkey % 10 = 0 THEN 'No aplica' WHEN l_partkey % 5 = 0 THEN 'No indica' END",
    "st_rel_h": "CASE WHEN l_partkey % 12 = 0 THEN 'No aplica' END",
    "ev_muestra": "l_partkey % 3 <> 0",
    "ev_r": "l_partkey % 4 <> 0",
    "quote_muestra": "'n = ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' personas'",
    "method": """CASE l_suppkey % 4 WHEN 0 THEN 'Pearson observado' WHEN 1 THEN 'Correlación entre compuestos PLS'
        WHEN 2 THEN 'Correlación entre variables latentes CB-SEM' END""",
    "technique": "CASE l_partkey % 4 WHEN 0 THEN 'Regresión' WHEN 1 THEN 'PLS' WHEN 2 THEN 'CB-SEM latente' END",
    "effect": "CASE l_linenumber % 2 WHEN 0 THEN 'simple' ELSE 'parcial' END",
    "r_derived": "CASE WHEN l_partkey % 9 = 0 THEN 0.25 END",
    "r_imputed": f"CASE WHEN l_partkey % 4 = 0 THEN round(0.98 * coalesce({_BETA}, 0) + 0.05, 3) END",
    "zero": "l_partkey % 13 = 0",
    "others": "l_partkey % 17 = 0",
    "chosen_set": "CASE l_partkey % 3 WHEN 0 THEN 'Principal' WHEN 1 THEN 'Sensibilidad' ELSE 'Narrativo' END",
    "motive": "'Condición ' || CAST(1 + l_suppkey % 11 AS STRING) || ': razón'",
    "warned": "l_suppkey % 2 = 0",
    "inferred": "l_partkey % 6 = 5",
    "disputed": "l_partkey % 8 = 7",
}
ROW_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
CODED = f"""coded AS (
  SELECT l_linestatus AS project_id, CAST(l_orderkey AS STRING) AS extraction_id,
    row_number() OVER (PARTITION BY l_linestatus, l_orderkey ORDER BY {ROW_ORDER}) - 1 AS row_pos, {", ".join(f"{e} AS {a}" for a, e in CODED_EXPR.items())}
  FROM lineitem
)"""

#: Parts of coded rows for each split of their table.
SHARES = 16


def numbered(t: Tables) -> DataFrame:
    """Lines with their place in their coding: columns of the table alone, a fraction of the size of what is derived from them."""
    rn = f"row_number() OVER (PARTITION BY project_id, extraction_id ORDER BY {ROW_ORDER}) - 1 AS row_pos"
    return dealt(t.read("lineitem").selectExpr("l_linestatus AS project_id", "CAST(l_orderkey AS STRING) AS extraction_id", "*")).selectExpr("*", rn)


def dealt(lines: DataFrame) -> DataFrame:
    """Lines by extraction. Values are many times as wide, so partitions by the size of lines would be too few: they follow the splits that are read."""
    return lines.repartition(SHARES * max(1, lines.rdd.getNumPartitions()), "project_id", "extraction_id")


def coded_wide(t: Tables, lines: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat coded rows: the order is the extraction, its line status the project. ``lines`` are numbered ones, of which ``keep`` stay too.

    Rows are numbered first and derived afterwards: Spark puts expressions beside a window below its shuffle, which would carry them all.
    """
    lines = numbered(t) if lines is None else lines
    return lines.selectExpr("project_id", "extraction_id", "row_pos", *[f"{e} AS {a}" for a, e in CODED_EXPR.items()], *keep)


# column of the coding: flat alias and kind
FILA = {
    "Estudio": ("estudio", int_cell), "Documento": ("documento", int_cell), "Author": ("author", text_cell), "Año": ("anio", int_cell),
    "Cita": ("cita", text_cell), "Muestra": ("muestra", int_cell), "Correlación Feli 1 - JP": ("r", float_cell),
    "Beta Fel 1- JP": ("beta", float_cell), "Correlacion o Beta felicidad 1 - JP": ("transcript", text_cell), "# Ítems": ("items", int_cell),
    "Items instrumento1": ("items1", int_cell), "Fiabilidad Alfa - Omega (desempeño)": ("rel_p", float_cell),
    "Fiabilidad Alfa - Omega (felicidad)": ("rel_h", float_cell), "Covidence #": ("covidence", int_cell), "Nivel": ("nivel", text_cell),
    "Study design": ("design", text_cell), "Incluir en meta análisi": ("include", text_cell),
    "Direccionalidad de la relación": ("direction", text_cell), "Validez?": ("valid", text_cell), "Validez de las escalas": ("scales", text_cell),
    "Validez CFA": ("valid_cfa", text_cell), "CFA": ("cfa", text_cell), "Start date": ("start_date", text_cell), "End date": ("end_date", text_cell),
    "Conclusion": ("conclusion", text_cell), "Tipo de felicidad real": ("happiness", text_cell), "Hedónica/eudaimónica": ("family", text_cell),
    "Pais": ("country", text_cell), "Población": ("population", text_cell),
}


def proof_map() -> Column:
    """Evidence of a flat row, by column."""
    proof = F.array(F.struct(
        F.lit(3).alias("pagina_pdf"), F.lit("Tabla 2").alias("ubicacion"), F.lit("SWB").alias("fila_tabla"), F.lit(None).cast("string").alias("columna_tabla"),
        F.col("quote_muestra").alias("cita_textual"), F.lit(False).alias("leido_de_figura"), F.lit("p03-b01").alias("bloque_id"))).cast(f"array<{EVIDENCE_TYPE}>")
    return F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(a), F.struct(F.lit(k).alias("k"), proof.alias("v"))) for k, a in (("Muestra", "ev_muestra"), ("Correlación Feli 1 - JP", "ev_r"))])))


def coded(t: Tables, wide: DataFrame | None = None, looked_up: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same rows as codings: typed values and trace; ``looked_up`` adds each value as a column too, as ``rules.with_values``
    does, so that no map is built for them. Columns of ``wide`` to ``keep`` stay."""
    w = coded_wide(t) if wide is None else wide
    fila = F.create_map(*[x for key, (alias, kind) in FILA.items() for x in (F.lit(key), kind(F.col(alias)).cast(CELL_TYPE))])
    states = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(a).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(a).alias("v")))
        for k, a in (("Muestra", "st_muestra"), ("Correlación Feli 1 - JP", "st_r"), ("Fiabilidad Alfa - Omega (desempeño)", "st_rel_p"),
                     ("Fiabilidad Alfa - Omega (felicidad)", "st_rel_h"))])))
    proofs = proof_map()
    some = F.array(F.struct(F.lit("otro").alias("descripcion"), F.lit("0.1").alias("valor"), F.lit("p. 2").alias("evidencia")))
    inferences = F.array_compact(F.array(F.when(F.col("inferred"), F.struct(
        F.lit("Muestra (fila 1)").alias("columna"), F.col("sample").alias("valor"), F.lit("regla 4").alias("regla_aplicada"), F.lit("por contexto").alias("razonamiento")))))
    disputes = F.array_compact(F.array(F.when(F.col("disputed"), F.struct(
        F.lit("Nivel").alias("columna"), F.lit("Tabla 1").alias("fuente_1"), F.lit("texto").alias("fuente_2"), F.col("nivel").alias("valor_adoptado")))))
    warnings = F.array_compact(F.array(F.when(F.col("warned"), F.lit("Lenguaje CAUSAL en la conclusión"))))
    given = {
        "id_muestra": F.col("sample"), "via_de_identificacion": F.col("via"), "estado_del_dato": states, "evidencia": proofs, "metodo_obtencion_r": F.col("method"),
        "r_derivado": F.col("r_derived"), "r_imputado_desde_beta": F.col("r_imputed"), "tipo_de_efecto": F.col("effect"), "tecnica_del_beta": F.col("technique"),
        "sensibilidad_r_cero": F.col("zero"), "conjunto_sugerido": F.col("chosen_set"), "motivo_decision_inclusion": F.col("motive"),
        "otros_coeficientes": F.when(F.col("others"), some).otherwise(F.array().cast("array<struct<descripcion:string,valor:string,evidencia:string>>")),
        "inferencias": inferences, "discrepancias_en_el_articulo": disputes, "advertencias_pendientes": warnings,
        "confianza": F.lit("alta"), "extractor": F.lit("uno"), "fecha_extraccion": F.lit("2026-10-05"), "verificador": F.lit("dos"),
    }
    parts = [given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in TRACE_FIELDS.items()]
    # no cast: it would build each value before a part of it is taken
    own = {key: kind(F.col(alias)) for key, (alias, kind) in FILA.items()} if looked_up else {}
    own |= {key: F.lit(None).cast(CELL_TYPE) for key in CRITICAL_ROW_FIELDS if key not in own} if looked_up else {}
    return w.select("project_id", "extraction_id", F.col("extraction_id").alias("doc_id"), "row_pos", fila.alias("fila"), F.struct(*parts).alias("traz"),
                    *(v.alias(f"v:{key}") for key, v in own.items()), *keep)


#: Trace fields that are compared, by the flat column that holds them; the others have no value.
_COMPARED_TRACE = {"metodo_obtencion_r": "method", "tipo_de_efecto": "effect", "tecnica_del_beta": "technique"}


def compared_values() -> dict[str, Column]:
    """Cells of the fields that are compared, from the columns of :func:`coded_flat`."""
    rows = {k: FILA[k][1](F.col(FILA[k][0])) if k in FILA else null_cell() for k in (STUDY, *CRITICAL_ROW_FIELDS)}
    return rows | {k: text_cell(F.col(_COMPARED_TRACE[k])) if k in _COMPARED_TRACE else null_cell() for k in CRITICAL_TRACE_FIELDS}


def coded_flat(t: Tables, wide: DataFrame | None = None) -> DataFrame:
    """Coded rows as they are compared: flat values and the evidence, without maps of values and traces."""
    return (coded_wide(t) if wide is None else wide).withColumn("evidencia", proof_map())


def codebook_columns(t: Tables) -> DataFrame:
    """A catalogue for the coded rows, one per project found in the data."""
    numeric = {"Muestra": "entero o null", "Covidence #": "entero o null", "# Ítems": "entero", "Items instrumento1": "entero", "Estudio": "entero",
               "Documento": "entero", "Año": "entero"}
    rows = []
    for i, (key, (_, kind)) in enumerate(FILA.items(), 1):
        data_type = numeric.get(key, "número o null" if kind is float_cell else "texto")
        allowed = ["SI", "No", "PLS", "Otro: (texto)"] if key == "Incluir en meta análisi" else (["Group", "Multinivel", "Individual"] if key == "Nivel" else None)
        rows.append((key, key, chr(64 + i) if i <= 26 else "A" + chr(38 + i), i, data_type, key in ("Cita", "Author"), allowed,
                     key in ("Muestra", "Correlación Feli 1 - JP", "Nivel"), "Documento" if key in ("Pais", "Año", "Author", "Study design") else "Efecto",
                     data_type in ("entero", "entero o null", "número o null")))
    fixed = t.spark.createDataFrame(
        rows, "key string, header string, letter string, position int, data_type string, required boolean, allowed array<string>, "
              "needs_evidence boolean, level string, is_numeric boolean")
    projects = t.read("lineitem").select(F.col("l_linestatus").alias("project_id")).distinct()
    every = F.array(*[F.lit(r[0]) for r in rows])
    return projects.select("project_id", F.explode(every).alias("key")).join(fixed, "key")
