"""Quality gate over coded rows.

Row rules are array expressions over one coded row, so all of them run in one narrow projection. Rules about
groups of rows are aggregations. Every rule gives (rule, severity, column, message) rows; severity E blocks,
A warns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.text import norm, numbers_in, word_count
from quoteloom.functions.typed import cell_json, cell_text, is_null, is_number, value_key
from quoteloom.operators.anchoring import evidence_of, locate_literal
from quoteloom.operators.documents import DOC, anchor_variants
from quoteloom.session import cut_lineage
from quoteloom.vocab import (
    BETA_COL, CITATION_PATTERN, COVIDENCE, DOCUMENT, INCLUDE, MISSING_CODES, MULTI_CATEGORY, NOT_APPLICABLE, NOT_STATED,
    NUMERIC_RULE_KEYS, NUMERIC_TYPES, R_COL, REL_HAPPY, REL_PERF, SAMPLE_CONSTANT_KEYS, STUDY, TRANSCRIPT,
    WORKING_NOTE_PATTERN,
)

ROW = ["project_id", "extraction_id", "doc_id", "row_pos"]
RULE_KEYS = list(dict.fromkeys([
    STUDY, DOCUMENT, "Author", "Cita", "Año", INCLUDE, TRANSCRIPT, *NUMERIC_RULE_KEYS, "Nivel", "Direccionalidad de la relación", "Validez?",
    "Validez de las escalas", "Validez CFA", "CFA", "Start date", "End date", "Conclusion", "Tipo de felicidad real", "Hedónica/eudaimónica",
    *SAMPLE_CONSTANT_KEYS,
]))
VIOLATION = "struct<rule:string,severity:string,column:string,message:string>"


# ------------------------------------------------------------------ access to one row
def value(key: str) -> Column:
    """Value of a column named by a rule; :func:`with_values` puts it there."""
    return F.col(f"`v:{key}`")


def with_values(rows: DataFrame) -> DataFrame:
    """Looks every column a rule names up once; what a query does not use is pruned.

    Rows that bring ``v:`` columns (see ``derived.coded``) are taken as they are, so the map of all values need not be built.
    """
    return rows.withColumns({f"v:{k}": F.col("fila")[k] for k in RULE_KEYS if f"v:{k}" not in rows.columns})


def num(key: str) -> Column:
    return value(key)["num"]


def text(key: str) -> Column:
    return value(key)["str"]


def missing(key: str) -> Column:
    return is_null(value(key))


def traz(field: str) -> Column:
    return F.col(f"traz.{field}")


def state_of(key: str) -> Column:
    return F.when(traz("estado_del_dato").isNotNull(), traz("estado_del_dato")[key])


def _same(a: Column, b: Column | str) -> Column:
    return a.eqNullSafe(F.lit(b) if isinstance(b, str) else b)


def problem(rule: str, severity: str, column: Column | str | None, message: Column | str, when: Column) -> Column:
    """One violation, or null where the condition does not hold."""
    col = F.lit(column) if column is None or isinstance(column, str) else column
    msg = F.lit(message) if isinstance(message, str) else message
    body = F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), col.cast("string").alias("column"), msg.alias("message")
    )
    return F.when(F.coalesce(when, F.lit(False)), body)


# ------------------------------------------------------------------ row rules: each returns a list of columns
def v03_citation() -> list[Column]:
    cita = text("Cita")
    authors = F.filter(F.transform(F.split(text("Author"), ";"), lambda a: F.trim(a)), lambda a: a != "")
    surname = F.coalesce(F.try_element_at(F.split(F.get(authors, F.lit(0)), r"\s+"), F.lit(-1)), F.lit(""))
    valid = cita.rlike(CITATION_PATTERN)
    first = F.regexp_extract(cita, CITATION_PATTERN, 1)
    year = F.regexp_extract(cita, CITATION_PATTERN, 3).try_cast("int")
    form = F.when(cita.contains("et al."), "et").when(cita.contains(" y "), "y").otherwise("uno")
    n = F.size(authors)
    expected = F.when(n == 1, "uno").when(n == 2, "y").otherwise("et")
    return [
        problem("V03", "E", "Cita", F.concat(F.lit("Cita con formato inválido: "), cita), ~valid),
        problem("V03", "E", "Cita",
                F.concat(F.lit("Cita '"), cita, F.lit("' no empieza con el apellido del primer autor '"), surname, F.lit("'")),
                valid & (norm(first) != norm(surname))),
        problem("V03", "E", "Cita", "Año de la Cita distinto de Año", valid & ~_same(year.cast("double"), num("Año"))),
        problem("V03", "E", "Cita",
                F.format_string("Cita no sigue la regla del número de autores (%s autores)", n), valid & (form != expected)),
    ]


def v06_missing_state() -> list[Column]:
    out = [
        problem("V06", "E", k, f"'{k}' es null sin código en estado_del_dato", missing(k) & ~has_state(k))
        for k in NUMERIC_RULE_KEYS if k != COVIDENCE
    ]
    out.append(problem("V06", "E", COVIDENCE, "Covidence # vacío pero via_de_identificacion = Covidence",
                       missing(COVIDENCE) & (traz("via_de_identificacion") == "Covidence")))
    return out


def has_state(key: str) -> Column:
    return F.coalesce(F.map_contains_key(traz("estado_del_dato"), key), F.lit(False))


def v09_sample() -> list[Column]:
    return [problem("V09", "E", "Muestra", "Muestra null exige Incluir = No", missing("Muestra") & ~_same(text(INCLUDE), "No"))]


def v10_transcript() -> list[Column]:
    numbers = numbers_in(text(TRANSCRIPT))

    def check(k: str) -> Column:
        absent = ~F.exists(numbers, lambda x: F.abs(F.abs(num(k)) - x) < 0.0005)
        return problem("V10", "E", k, F.concat(F.lit(f"{k} = "), cell_json(value(k)), F.lit(" no aparece en la transcripción")),
                       ~missing(k) & absent)

    return [check(R_COL), check(BETA_COL)]


def v11_single_item() -> list[Column]:
    out = []
    for items, rel, label in (("# Ítems", REL_PERF, "Desempeño"), ("Items instrumento1", REL_HAPPY, "Felicidad")):
        fine = missing(rel) & _same(state_of(rel), NOT_APPLICABLE)
        out.append(problem("V11", "E", rel, f"{label} de un ítem: la fiabilidad debe ser null con estado No aplica",
                           (num(items) == 1) & ~fine))
    return out


def inclusion() -> Column:
    """Category and number of the first condition of the inclusion tree that holds."""
    r, b = missing(R_COL), missing(BETA_COL)
    zero = F.coalesce(traz("sensibilidad_r_cero"), F.lit(False))
    others = F.coalesce(F.size(traz("otros_coeficientes")), F.lit(0)) > 0
    method, technique = traz("metodo_obtencion_r"), traz("tecnica_del_beta")
    # fixed values: the ordered conditions and their categories
    ordered = [
        (missing("Muestra"), "No"),
        (r & b & ~zero & ~others & traz("r_derivado").isNull(), "No"),
        (_same(text("Nivel"), "Group"), "Organizacional"),
        (_same(text("Study design"), "Randomised controlled trial"), "Experimental"),
        (_same(text("Nivel"), "Multinivel"), "Multinivel"),
        ((~r & _same(method, "Pearson observado")) | traz("r_derivado").isNotNull(), "SI"),
        (traz("r_imputado_desde_beta").isNotNull(), "SI"),
        (_same(method, "Correlación entre compuestos PLS") | _same(technique, "PLS"), "PLS"),
        (_same(method, "Correlación entre variables latentes CB-SEM") | _same(technique, "CB-SEM latente"), "SEM latente"),
        (zero, "No"),
        (F.lit(True), "No"),
    ]
    struct = [F.when(c, F.struct(F.lit(cat).alias("category"), F.lit(i).alias("condition"))) for i, (c, cat) in enumerate(ordered, 1)]
    return F.coalesce(*struct)


def v12_inclusion() -> list[Column]:
    tree = F.col("_tree")
    wrong = ~_same(text(INCLUDE), tree["category"])
    prefix = F.format_string("Condición %s:", tree["condition"])
    return [
        problem("V12", "E", INCLUDE,
                F.format_string("Incluir = %s pero el árbol da %s (condición %s)", text(INCLUDE), tree["category"], tree["condition"]),
                wrong),
        problem("V12", "E", INCLUDE,
                F.concat(F.lit("motivo_decision_inclusion debe empezar con '"), prefix, F.lit("'")),
                ~wrong & ~F.startswith(F.coalesce(traz("motivo_decision_inclusion"), F.lit("")), prefix)),
    ]


def v14_imputed() -> list[Column]:
    b, ri = num(BETA_COL), traz("r_imputado_desde_beta")
    allowed = F.coalesce(
        ~missing(BETA_COL) & (F.abs(b) <= 0.5) & (traz("tecnica_del_beta") == "Regresión") & (traz("tipo_de_efecto") == "parcial"),
        F.lit(False),
    )
    formula = 0.98 * b + F.when(b >= 0, 0.05).otherwise(0.0)
    return [
        problem("V14", "E", BETA_COL, "r_imputado_desde_beta no permitido para este beta", ri.isNotNull() & ~allowed),
        problem("V14", "E", BETA_COL, "r_imputado_desde_beta no coincide con Peterson y Brown",
                ri.isNotNull() & allowed & (F.abs(ri - formula) > 0.001)),
    ]


def v15_direction() -> list[Column]:
    coef = F.coalesce(num(R_COL), num(BETA_COL))
    direction = text("Direccionalidad de la relación")
    return [
        problem("V15", "A", R_COL, "Coeficiente negativo con HP", (coef < 0) & direction.contains("HP")),
        problem("V15", "A", R_COL, "Coeficiente positivo con Relación negativa", (coef > 0) & direction.contains("Relación negativa")),
    ]


def v16_validity() -> list[Column]:
    scales = text("Validez de las escalas")
    return [problem("V16", "A", "Validez?", "Validez? y Validez de las escalas no son coherentes",
                    _same(text("Validez?"), "Si") == _same(scales, NOT_STATED))]


def v17_factor_analysis() -> list[Column]:
    named = F.coalesce(text("Validez de las escalas").rlike("(?i)AFC|CFA|confirmator"), F.lit(False))
    return [problem("V17", "A", "CFA", "CFA = Si pero Validez de las escalas no menciona AFC",
                    (_same(text("Validez CFA"), "Si") | _same(text("CFA"), "Si")) & ~named)]


def v18_dates() -> list[Column]:
    dates = F.filter(F.array(text("Start date"), text("End date")), lambda x: x.isNotNull() & (x != NOT_STATED))
    return [
        problem("V18", "A", "Start date", "Start date posterior a End date",
                (F.size(dates) == 2) & (F.get(dates, F.lit(0)) > F.get(dates, F.lit(1)))),
        problem("V18", "A", "Start date", "Fecha de recolección posterior al año de publicación",
                F.exists(dates, lambda x: F.substring(x, 1, 4).try_cast("int") > num("Año"))),
    ]


def v19_reliability() -> list[Column]:
    return [
        problem("V19", "A", k, F.concat(F.lit(f"{k} = "), cell_json(value(k)), F.lit(" menor a 0.70: confirmar")), num(k) < 0.70)
        for k in (REL_PERF, REL_HAPPY)
    ]


def v21_causal() -> list[Column]:
    noted = F.exists(F.coalesce(traz("advertencias_pendientes"), F.array().cast("array<string>")), lambda x: F.lower(x).contains("causal"))
    return [problem("V21", "A", "Conclusion",
                    "Diseño transversal con lenguaje causal en Conclusion; anotarlo en advertencias_pendientes",
                    (text("Study design") == "Cross sectional study")
                    & text("Conclusion").rlike(r"(?i)\bcaus|provoca|efecto causal") & ~noted)]


def v26_beta() -> list[Column]:
    return [problem("V26", "A", BETA_COL, "|Beta| > 1: confirmar que es estandarizado", F.abs(num(BETA_COL)) > 1)]


def expected_set(condition: Column) -> Column:
    """Suggested set that follows from the inclusion condition."""
    return F.when(condition == 6, "Principal").when(condition.isin(5, 7, 8, 9, 10), "Sensibilidad").otherwise("Narrativo")


def v27_set() -> list[Column]:
    expected = expected_set(F.col("_tree.condition"))
    return [problem("V27", "E", "conjunto_sugerido",
                    F.format_string("conjunto_sugerido = %s, esperado %s", traz("conjunto_sugerido"), expected),
                    ~_same(traz("conjunto_sugerido"), expected))]


def v28_simple_effect() -> list[Column]:
    return [problem("V28", "A", R_COL,
                    F.concat(F.lit("Efecto simple con r = "), cell_json(value(R_COL)), F.lit(" y Beta = "),
                             cell_json(value(BETA_COL)), F.lit(": revisar")),
                    (traz("tipo_de_efecto") == "simple") & (F.abs(num(R_COL) - num(BETA_COL)) > 0.05))]


def v29_derived() -> list[Column]:
    return [problem("V29", "E", R_COL, "r_derivado no puede provenir de un beta latente",
                    traz("r_derivado").isNotNull() & traz("tecnica_del_beta").isin("CB-SEM latente", "PLS")
                    & ~_same(traz("metodo_obtencion_r"), "Pearson observado"))]


ROW_RULES: dict[str, Callable[[], list[Column]]] = {
    "V03": v03_citation, "V06": v06_missing_state, "V09": v09_sample, "V10": v10_transcript, "V11": v11_single_item,
    "V12": v12_inclusion, "V14": v14_imputed, "V15": v15_direction, "V16": v16_validity, "V17": v17_factor_analysis,
    "V18": v18_dates, "V19": v19_reliability, "V21": v21_causal, "V26": v26_beta, "V27": v27_set, "V28": v28_simple_effect,
    "V29": v29_derived,
}


def row_violations(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Violations of the row rules, in one pass without a shuffle."""
    chosen = [ROW_RULES[n] for n in (names or list(ROW_RULES))]
    checks = [c for rule in chosen for c in rule()]
    prepared = with_values(rows).withColumn("_tree", inclusion())
    return prepared.select(*ROW, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(*ROW, "v.*")


def _rows_from_array(rows: DataFrame, items: Column, rule: str, severity: str, column: Callable, message: Callable) -> DataFrame:
    exploded = rows.select(*ROW, F.explode(items).alias("_x"))
    return exploded.select(
        *ROW, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        column(F.col("_x")).alias("column"), message(F.col("_x")).alias("message"),
    )


def v22_working_notes(rows: DataFrame) -> DataFrame:
    """Texts that look like notes to self."""
    hits = F.filter(F.map_entries("fila"), lambda e: (e["value"]["kind"] == "str") & e["value"]["str"].rlike(WORKING_NOTE_PATTERN))
    return _rows_from_array(rows, hits, "V22", "A", lambda x: x["key"],
                            lambda x: F.concat(F.lit("Posible nota de trabajo en '"), x["key"], F.lit("'")))


def v23_long_quotes(rows: DataFrame, limit: int = 25) -> DataFrame:
    """Quotes of more than the allowed words."""
    ev = evidence_of(rows).filter(word_count("quote") > limit)
    return ev.select(*ROW, F.lit("V23").alias("rule"), F.lit("E").alias("severity"), "column",
                     F.format_string("Cita de '%s' supera 25 palabras", F.col("column")).alias("message"))


def full_text(blocks: DataFrame) -> DataFrame:
    """Comparable text of each document: the texts of its blocks in reading order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.array_join("variants", "\n").alias("t"))))
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["t"] != ""), lambda p: p["t"]), "\n")
    return blocks.withColumn("variants", anchor_variants()).groupBy(*DOC).agg(norm(joined).alias("text_norm"))


def v23_not_literal(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Quotes not read from a figure that the article text does not hold.

    A quote inside one block is settled by word keys. Only quotes still open, which may run over a block border,
    are looked up in the text of their own document.
    """
    blocks = blocks.withColumn("variants", anchor_variants())
    quotes = evidence.filter("not figure").withColumn("q", norm(F.coalesce("quote", F.lit("")))).filter("q <> ''")
    inside = locate_literal(quotes.select(*DOC, "q"), blocks, DOC, ["block_id"]).select(*DOC, "q").distinct()
    open_ = quotes.join(inside, [*DOC, "q"], "left_anti")
    texts = full_text(blocks.join(open_.select(*DOC).distinct(), DOC, "left_semi"))
    return _not_literal(open_, texts)


def _not_literal(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes whose document has a text that lacks them; ``texts``: project, document, text_norm."""
    q, t = quotes.alias("q"), texts.alias("t")
    same = (F.col("q.project_id") == F.col("t.project_id")) & (F.col("q.doc_id") == F.col("t.doc_id"))
    joined = q.join(t, same, "left").filter(~F.coalesce(F.contains(F.col("t.text_norm"), F.col("q.q")), F.lit(False)))
    return joined.select(
        *[F.col(f"q.{c}") for c in ROW], F.lit("V23").alias("rule"), F.lit("E").alias("severity"), F.col("q.column").alias("column"),
        F.format_string("Cita de '%s' no se encuentra literal en el PDF: %s", F.col("q.column"), F.col("q.quote")).alias("message"),
    )


def v23_not_in_text(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """The same check where the comparable text of the article is at hand as one value per document."""
    quotes = evidence.filter("not figure").withColumn("q", norm(F.coalesce("quote", F.lit("")))).filter("q <> ''")
    return _not_literal(quotes, texts)


# ------------------------------------------------------------------ rules with codebook metadata
def codebook_meta(columns: DataFrame) -> DataFrame:
    """Per project: keys that need evidence and keys constant within a document, stored, so that Spark knows how small they are."""
    return cut_lineage(columns.groupBy("project_id").agg(
        F.collect_list(F.when(F.col("needs_evidence"), F.col("key"))).alias("needs_evidence"),
        F.collect_list(F.when(F.col("level") == "Documento", F.col("key"))).alias("document_level"),
    ))


def v13_evidence(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Real values of columns that need evidence but have no evidence key; an empty list passes."""
    joined = rows.join(meta.select("project_id", "needs_evidence"), "project_id")
    evidence_keys = F.coalesce(F.map_keys(traz("evidencia")), F.array().cast("array<string>"))

    def lacks(k: Column) -> Column:
        v = F.col("fila")[k]
        real = ~is_null(v) & ~F.coalesce(v["str"].isin(MISSING_CODES), F.lit(False))
        return real & ~F.array_contains(evidence_keys, k)

    return _rows_from_array(joined, F.filter("needs_evidence", lacks), "V13", "E", lambda x: x,
                            lambda x: F.format_string("'%s' tiene valor sin evidencia", x))


def v25_happiness_type(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Kind of happiness against the correspondence of the codebook; ``types``: project_id, type, family."""
    own = with_values(rows).select(*ROW, text("Tipo de felicidad real").alias("type"), text("Hedónica/eudaimónica").alias("given"))
    wrong = own.join(types, ["project_id", "type"]).filter(
        ~F.startswith("type", F.lit("Orientación")) & ~F.col("family").eqNullSafe(F.col("given")))
    return wrong.select(*ROW, F.lit("V25").alias("rule"), F.lit("A").alias("severity"), F.lit("Tipo de felicidad real").alias("column"),
                        F.format_string("Tipo %s corresponde a %s, no a %s", "type", "family", "given").alias("message"))


# ------------------------------------------------------------------ rules about groups of rows
def v01_repeated_study(rows: DataFrame) -> DataFrame:
    study = value_key(value(STUDY))
    w = Window.partitionBy("project_id", "extraction_id", "_study").orderBy("row_pos")
    again = (
        with_values(rows).select(*ROW, study.alias("_study"), cell_text(value(STUDY)).alias("_shown"))
        .withColumn("_n", F.row_number().over(w)).filter("_n > 1 and not (_shown <=> 'PENDIENTE_EQUIPO')")
    )
    return again.select(*ROW, F.lit("V01").alias("rule"), F.lit("E").alias("severity"), F.lit(STUDY).alias("column"),
                        F.format_string("Estudio %s repetido", "_shown").alias("message"))


def _with_several_values(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one distinct ``v``. Distinct values are reduced before the shuffle, so a hot key is small."""
    return cells.select(*keys, "v").distinct().groupBy(*keys).count().filter("count > 1").drop("count")


def v02_document_constant(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Document-level columns that change inside a document; 1 and 1.0 differ."""
    # each value is read before the row is repeated, so that no repetition carries the whole row
    keys = F.filter("document_level", lambda k: k.isNotNull())
    values = F.transform(keys, lambda k: F.struct(k.alias("column"), cell_json(F.col("fila")[k]).alias("v")))
    cells = with_values(rows).join(meta.select("project_id", "document_level"), "project_id").select(
        "project_id", "extraction_id", value_key(value(DOCUMENT)).alias("document"), F.explode(values).alias("e"))
    changing = _with_several_values(
        cells.select("project_id", "extraction_id", "document", "e.*"), ["project_id", "extraction_id", "document", "column"])
    return changing.select(
        "project_id", "extraction_id", "document", F.lit("V02").alias("rule"), F.lit("E").alias("severity"), "column",
        F.format_string("Documento %s: '%s' cambia entre filas", "document", "column").alias("message"))


def v20_sample_constant(rows: DataFrame) -> DataFrame:
    """Country, population, design and dates that change inside a sample."""
    entries = F.array(*[F.struct(F.lit(k).alias("column"), value_key(value(k)).alias("v")) for k in SAMPLE_CONSTANT_KEYS])
    cells = with_values(rows).select("project_id", "extraction_id", traz("id_muestra").alias("sample"), F.explode(entries).alias("e"))
    changing = _with_several_values(cells.select("project_id", "extraction_id", "sample", "e.*"), ["project_id", "extraction_id", "sample", "column"])
    return (
        changing.select("project_id", "extraction_id", "sample", F.lit("V20").alias("rule"), F.lit("A").alias("severity"), "column",
                F.format_string("Muestra %s: '%s' cambia entre filas", "sample", "column").alias("message"))
    )


# ------------------------------------------------------------------ schema gate
def vocabulary_ok(c: Column, allowed: Column, data_type: Column) -> Column:
    """A missing value passes; a text passes when each of its categories is allowed or fits an allowed ``Otro:``."""
    other = F.exists(allowed, lambda p: F.startswith(p, F.lit("Otro:")))
    parts = F.when(data_type == MULTI_CATEGORY, F.split(c["str"], "; ")).otherwise(F.array(c["str"]))
    listed = F.forall(parts, lambda p: F.array_contains(allowed, p) | (other & p.rlike(r"^Otro: \S.*$")))
    return (
        F.when(is_null(c) | allowed.isNull() | (F.size(allowed) <= 0), True)
        .when(c["kind"] != "str", False)
        .otherwise(F.coalesce(listed, F.lit(False)))
    )


def _with_faults(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows with ``_faults``, the (column, message) of their schema violations.

    What the codebook says of a project is one small stored row, so rows are not dealt out by project, of which there are few,
    and no row is repeated for each of its columns.
    """
    spec = F.struct("data_type", "required", "allowed")
    of_key = columns.filter("key is not null").groupBy("project_id", "key").agg(F.collect_list(spec).alias("specs"))
    of_project = cut_lineage(of_key.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "specs"))).alias("_specs")))

    def fault(column: Column, message: str) -> Column:
        return F.struct(column.alias("column"), F.lit(message).alias("message"))

    def of_cell(key: Column, v: Column, s: Column) -> Column:
        data_type = s["data_type"]
        integer = is_number(v) & (v["num"] == F.floor(v["num"]))
        typed = (
            F.when(data_type == "entero", integer)
            .when(data_type == "entero o null", is_null(v) | integer)
            .when(data_type == "número o null", is_null(v) | is_number(v))
            .otherwise(is_null(v) | F.coalesce(v["kind"] == "str", F.lit(False)))
        )
        return F.array(
            F.when(s["required"] & is_null(v) & ~data_type.isin(NUMERIC_TYPES), fault(key, "required")),
            F.when(~F.coalesce(typed, F.lit(False)), fault(key, "type")),
            F.when(~vocabulary_ok(v, s["allowed"], data_type), fault(key, "vocabulary")),
        )

    def of_entry(e: Column) -> Column:
        known = F.flatten(F.transform(F.col("_specs")[e["key"]], lambda s: of_cell(e["key"], e["value"], s)))
        return F.coalesce(known, F.array(fault(e["key"], "unknown column")))

    own = F.flatten(F.transform(F.map_entries("fila"), of_entry))
    # a key that a codebook lists twice is missing once
    absent = F.transform(F.array_except(F.map_keys("_specs"), F.map_keys("fila")), lambda k: fault(k, "missing key"))
    none = F.array().cast("array<struct<column:string,message:string>>")
    found = F.array_compact(F.concat(F.coalesce(own, none), F.coalesce(absent, none)))
    return rows.join(of_project, "project_id", "left").withColumn("_faults", found).drop("_specs")


def _faults_as_rows(marked: DataFrame) -> DataFrame:
    found = marked.select(*ROW, F.explode("_faults").alias("f"))
    return found.select(*ROW, F.lit("ESQUEMA").alias("rule"), F.lit("E").alias("severity"), "f.column", "f.message")


def schema_violations(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Types, vocabularies, required and unknown columns, driven by the codebook."""
    return _faults_as_rows(_with_faults(rows, columns))


def pass_gate(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of extractions without a schema violation; only these reach the other rules."""
    return rows.join(violations.select("project_id", "extraction_id").distinct(), ["project_id", "extraction_id"], "left_anti")


def strip_block_ids(rows: DataFrame) -> DataFrame:
    """Evidence without ``bloque_id``, for codebooks whose schema does not admit it."""
    bare = F.transform_values("traz.evidencia", lambda _, evs: F.transform(evs, lambda e: e.dropFields("bloque_id")))
    return rows.withColumn("traz", F.col("traz").withField("evidencia", bare))


def validate(rows: DataFrame, columns: DataFrame, types: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """All rules over the rows that pass the schema gate. Group rules leave ``row_pos`` empty.

    A row with faults of its own is left out before the rules. Rows whose extraction fails by another row are told by their
    extraction, for which what the rules found is dealt out, once for all rules, and not the wide rows. No group goes beyond its
    extraction, so the order makes no difference.
    """
    marked = cut_lineage(_with_faults(rows, columns))
    gate = _faults_as_rows(marked)
    # a row that names no extraction cannot fail one
    sound = marked.filter((F.size("_faults") == 0) | F.col("project_id").isNull() | F.col("extraction_id").isNull()).drop("_faults")
    meta = codebook_meta(columns)
    frames = [
        row_violations(sound), v01_repeated_study(sound), v13_evidence(sound, meta), v22_working_notes(sound),
        v23_long_quotes(sound), v25_happiness_type(sound, types), v02_document_constant(sound, meta), v20_sample_constant(sound),
    ]
    if blocks is not None:
        frames.append(v23_not_literal(evidence_of(sound), blocks))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).drop("document", "sample")
    # an anti-join would be taken down below the rules, where rows are wide; an outer join stays here
    failed = gate.select("project_id", "extraction_id").distinct().withColumn("_failed", F.lit(True))
    return gate.unionByName(found.join(failed, ["project_id", "extraction_id"], "left").filter("_failed is null").drop("_failed"), allowMissingColumns=True)


# ------------------------------------------------------------------ reports
def run_report(violations: DataFrame, keys: list[str]) -> DataFrame:
    """Errors and warnings per key and whether the key fails."""
    return violations.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "A").alias("warnings"),
    ).withColumn("failed", F.col("errors") > 0)


def rule_rollup(violations: DataFrame) -> DataFrame:
    """Counts per document and rule, with subtotals and the total."""
    return violations.rollup("doc_id", "rule").agg(F.count("*").alias("n"))


def parse_report(lines: DataFrame) -> DataFrame:
    """Errors and warnings of validator output; ``lines``: run_id, line_no, line.

    When a line announces schema errors, every line above it is an error as well.
    """
    announced = (
        lines.filter(F.trim("line").rlike(r"^\d+ errores de esquema")).groupBy("run_id").agg(F.min("line_no").alias("_end"))
    )
    t = F.rtrim("line")
    joined = lines.join(announced, "run_id", "left")
    kind = (
        F.when(F.startswith(t, F.lit("ERROR")), "error").when(F.startswith(t, F.lit("AVISO")), "warning")
        .when((F.col("line_no") < F.col("_end")) & (F.trim("line") != ""), "error")
    )
    labelled = F.when(t.rlike("^(ERROR|AVISO)"), F.trim(F.substr(t, F.lit(6)))).otherwise(F.trim(t))
    return joined.withColumn("kind", kind).filter("kind is not null").select("run_id", "line_no", "kind", labelled.alias("message"))


def coverage_exceptions(cells: DataFrame, columns: DataFrame, anchors: DataFrame) -> DataFrame:
    """Values that need evidence but have no anchor, and inferred values without rule or reasoning."""
    key = ["project_id", "study", "key"]
    anchored = anchors.select("project_id", "study", F.col("column").alias("key")).distinct().withColumn("_anchored", F.lit(True))
    joined = (
        cells.join(columns.select("project_id", "key", "needs_evidence"), ["project_id", "key"])
        .join(anchored, key, "left")
    )
    real = ~is_null(F.col("value")) & ~F.coalesce(F.col("value.str").isin(MISSING_CODES), F.lit(False))
    bare = F.col("inference").isNull() | (F.coalesce("inference.rule", F.lit("")) == "") | (F.coalesce("inference.reasoning", F.lit("")) == "")
    found = F.array_compact(F.array(
        F.when(F.col("needs_evidence") & real & F.col("_anchored").isNull() & (F.col("value_type") != "INFERIDO"), "value without anchor"),
        F.when((F.col("value_type") == "INFERIDO") & bare, "inference without rule or reasoning"),
    ))
    return joined.select("project_id", "document", "study", "key", F.explode(found).alias("problem"))
