"""The matrix of coded cells: import, assembly from a coding, upsert, paging, flags and marks.

``cells`` is long: project_id, study, document, article_id, origin, key, position, value (typed struct),
data_state, value_type, review_state, evidence (array), inference (struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import bind, norm
from quoteloom.functions.typed import cell_text, is_null
from quoteloom.operators.anchoring import initial_review_state, level_rank, norm_parts
from quoteloom.operators.ordering import in_ranges, ranged_sums, running_sum
from quoteloom.operators.rules import vocabulary_ok
from quoteloom.session import cut_lineage
from quoteloom.vocab import ANCHOR_LEVELS, COVIDENCE, DOCUMENT, MARK_PRIORITY, REVIEWED, STUDY

CELL_KEY = ["project_id", "study", "key"]


# ------------------------------------------------------------------ import of a wide sheet
def unpivot_wide(wide: DataFrame, ids: list[str], values: dict[str, Column]) -> DataFrame:
    """Wide to long: one typed cell per value column, in one narrow pass."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return wide.select(*ids, F.explode(entries).alias("_c")).select(*ids, "_c.*")


def whole_number(c: Column) -> Column:
    """Integer of a numeric cell; null for booleans, texts and fractions."""
    return F.when(c["kind"].isin("int", "float") & (c["num"] == F.floor(c["num"])), c["num"].cast("bigint"))


def import_rows(cells: DataFrame) -> DataFrame:
    """Study and document of each sheet row; ``cells``: project_id, row_no, key, value."""

    def own(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, whole_number(F.col("value"))))

    return cells.filter(F.col("key").isin(STUDY, DOCUMENT)).groupBy("project_id", "row_no").agg(
        own(STUDY).alias("study"), own(DOCUMENT).alias("document"))


def import_problems(rows: DataFrame) -> DataFrame:
    """Rows whose study or document is not a whole number, and studies that repeat."""
    bad = F.array_compact(F.array(
        F.when(F.col("study").isNull(), f"{STUDY} debe ser entero"), F.when(F.col("document").isNull(), f"{DOCUMENT} debe ser entero")))
    own = rows.select("project_id", "row_no", "study", F.explode(bad).alias("problem"))
    firsts = rows.filter("study is not null").groupBy("project_id", "study").agg(F.min("row_no").alias("_first"), F.count("*").alias("_n"))
    again = (
        rows.join(firsts.filter("_n > 1"), ["project_id", "study"]).filter("row_no > _first")
        .select("project_id", "row_no", "study", F.lit("Estudio repetido").alias("problem"))
    )
    return own.unionByName(again)


def imported_cells(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Inherited cells: values untouched, no evidence, flagged when out of vocabulary."""
    cols = columns.select("project_id", "key", "position", "allowed", "data_type")
    joined = cells.join(rows, ["project_id", "row_no"]).join(cols, ["project_id", "key"])
    return joined.select(
        "project_id", "study", "document", F.lit("HEREDADA").alias("origin"), "key", "position", "value", "row_no",
        F.when(is_null(F.col("value")), "FALTANTE").alias("value_type"), F.lit("SIN_EVIDENCIA").alias("review_state"),
        (~vocabulary_ok(F.col("value"), F.col("allowed"), F.col("data_type"))).alias("out_of_vocabulary"),
    )


def import_summary(cells: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows, documents, notes and out-of-vocabulary cells per project."""
    of_rows = cells.filter(F.col("key") == STUDY).groupBy("project_id").agg(F.count("*").alias("rows"))
    of_docs = cells.select("project_id", "document").distinct().groupBy("project_id").agg(F.count("*").alias("documents"))
    of_cells = cells.groupBy("project_id").agg(F.count_if("out_of_vocabulary").alias("out_of_vocabulary"))
    of_notes = notes.groupBy("project_id").agg(F.count("*").alias("notes"))
    out = of_rows.join(of_docs, "project_id").join(of_cells, "project_id").join(of_notes, "project_id", "left")
    return out.na.fill(0, ["notes"])


def import_guard(existing: DataFrame, replace: bool) -> DataFrame:
    """Whether each project may be imported: empty, or replaceable and without extracted rows."""
    counted = existing.groupBy("project_id").agg(
        F.count_if(F.col("origin") == "HEREDADA").alias("inherited"), F.count_if(F.col("origin") == "EXTRAIDA").alias("extracted"))
    outcome = F.when(~F.lit(replace), "needs replace").when(F.col("extracted") > 0, "extracted rows exist").otherwise("replace inherited")
    return counted.withColumn("outcome", outcome)


def without_inherited(existing: DataFrame, allowed: DataFrame) -> DataFrame:
    """Existing rows after the inherited ones of the allowed projects are dropped."""
    ok = allowed.filter("outcome = 'replace inherited'").select("project_id")
    keep = existing.filter("origin <> 'HEREDADA'")
    rest = existing.filter("origin = 'HEREDADA'").join(ok, "project_id", "left_anti")
    return keep.unionByName(rest)


# ------------------------------------------------------------------ cells of a coding
def value_type(value: Column, inferred: Column, quotes: Column) -> Column:
    """FALTANTE, INFERIDO, LITERAL (a quote holds the value) or CODIFICADO; ``quotes``: array of comparable texts."""
    v = norm(cell_text(value))
    cited = F.exists(quotes, lambda q: F.contains(q, v)) & (v != "")
    return (
        F.when(is_null(value), "FALTANTE").when(inferred, "INFERIDO")
        .when(F.coalesce(cited, F.lit(False)), "LITERAL").otherwise("CODIFICADO")
    )


def with_anchors(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows with the list ``_anchors`` of their own. The join deals rows out as they are: give them before their values are derived."""
    of_row = anchors.groupBy("project_id", "extraction_id", "row_pos").agg(
        F.collect_list(F.struct("column", "ev_idx", "level", "similarity", F.col("block_id").alias("anchor_block"), "page")).alias("_anchors"))
    return rows.join(of_row, ["project_id", "extraction_id", "row_pos"], "left")


def assemble_cells(rows: DataFrame, columns: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """One cell per catalogue column and coded row, absent columns included.

    Evidence and inferences already travel inside the coded row; only anchors are joined, once per row, unless ``rows`` come :func:`with_anchors`.
    """
    # stored, so that Spark knows how small it is: dealt by project, the wide rows would all be written to disk for a few tasks
    catalogue = cut_lineage(columns.select("project_id", "key", "position"))
    wide = (rows if anchors is None else with_anchors(rows, anchors)).join(catalogue, "project_id")
    key = F.col("key")
    raw = F.coalesce(F.col("traz.evidencia")[key], F.array().cast("array<struct<pagina_pdf:int,ubicacion:string,fila_tabla:string,columna_tabla:string,cita_textual:string,leido_de_figura:boolean,bloque_id:string>>"))
    mine = F.filter(F.coalesce("_anchors", F.array().cast("array<struct<column:string,ev_idx:int,level:string,similarity:double,anchor_block:string,page:int>>")),
                    lambda a: a["column"] == key)

    def with_anchor(own: Column) -> Column:
        return F.transform(
            F.filter(own["raw"], lambda e: e.isNotNull()),
            lambda e, i: F.struct(
                F.coalesce(e["pagina_pdf"], F.lit(0)).alias("page"), F.coalesce(e["ubicacion"], F.lit("")).alias("location"),
                F.coalesce(e["cita_textual"], F.lit("")).alias("quote"), F.coalesce(e["leido_de_figura"], F.lit(False)).alias("figure"),
                e["fila_tabla"].alias("table_row"), e["columna_tabla"].alias("table_col"), e["bloque_id"].alias("block_id"),
                F.get(F.filter(own["anchors"], lambda a: a["ev_idx"] == i), F.lit(0)).alias("anchor"),
            ),
        )

    evidence = bind(F.struct(raw.alias("raw"), mine.alias("anchors")), with_anchor)
    inference = F.try_element_at(F.filter("traz.inferencias", lambda x: x["columna"] == key), F.lit(-1))
    step = wide.withColumns({
        "value": F.col("fila")[key],
        "evidence": evidence,
        "inference": F.when(inference.isNotNull(), F.struct(
            F.coalesce(inference["regla_aplicada"], F.lit("")).alias("rule"), F.coalesce(inference["razonamiento"], F.lit("")).alias("reasoning"))),
    })
    quotes = F.coalesce(norm_parts(F.transform("evidence", lambda e: e["quote"])), F.array(F.lit("")))
    worst = F.array_max(F.transform("evidence", lambda e: level_rank(e["anchor"]["level"])))
    levels = F.array(*[F.lit(x) for x in ANCHOR_LEVELS])
    return step.withColumn("_quotes", quotes).select(
        "project_id", "extraction_id", "doc_id", "row_pos",
        whole_number(F.col("fila")[STUDY]).alias("study"), whole_number(F.col("fila")[DOCUMENT]).alias("document"),
        F.lit("EXTRAIDA").alias("origin"), "key", "position", "value",
        F.when(is_null(F.col("value")), F.col("traz.estado_del_dato")[key]).alias("data_state"),
        value_type(F.col("value"), F.col("inference").isNotNull(), F.col("_quotes")).alias("value_type"),
        "evidence", "inference",
        F.get(levels, (worst - 1).cast("int")).alias("anchor_level"),
        initial_review_state(F.get(levels, (worst - 1).cast("int"))).alias("review_state"),
    )


def findings_to_cells(findings: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Findings placed on cells: without study they go to every row of the extraction; an unknown column goes to
    the study cell with its name in front. ``rows``: project_id, extraction_id, study."""
    ext = ["project_id", "extraction_id"]
    targets = rows.select(*ext, "study").distinct()
    own = findings.filter("study is not null").join(targets, [*ext, "study"], "left_semi")
    spread = findings.filter("study is null").drop("study").join(targets, ext)
    placed = own.unionByName(spread)
    known = columns.select("project_id", F.col("key").alias("column")).withColumn("_known", F.lit(True))
    joined = placed.join(known, ["project_id", "column"], "left")
    return joined.select(
        *ext, "study", F.when(F.col("_known"), F.col("column")).otherwise(STUDY).alias("key"), "auditor", "verdict",
        F.when(F.col("_known"), F.col("detail")).otherwise(F.concat(F.lit("["), F.col("column"), F.lit("] "), F.col("detail"))).alias("detail"),
        "state",
    )


# ------------------------------------------------------------------ rows of the matrix
def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Existing rows with those of the batch in place of theirs; inside the batch the last one per key wins."""
    if order is not None:
        last = new.groupBy(*keys).agg(F.max(order).alias("_last"))
        new = new.join(last, keys).filter(F.col(order) == F.col("_last")).drop("_last")
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_count(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(new.select(*keys).distinct(), keys, "left_semi").groupBy("project_id").agg(F.count("*").alias("replaced"))


def next_study(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Next study number per project: the sequence or the largest study plus one; ``sequences``: project_id, sequence."""
    largest = rows.groupBy("project_id").agg(F.max("study").alias("_max"))
    both = sequences.join(largest, "project_id", "full_outer")
    return both.select("project_id", F.greatest(F.coalesce("sequence", F.lit(1)), F.coalesce(F.col("_max") + 1, F.lit(1))).alias("next_study"))


def reserve_studies(requests: DataFrame, starts: DataFrame) -> DataFrame:
    """Contiguous numbers for a batch, in request order; ``requests``: project_id, request_no, and own columns."""
    numbered = running_sum(requests, ["project_id"], "request_no", F.lit(1), "_n")
    return numbered.join(starts, "project_id").withColumn("study", F.col("next_study") + F.col("_n") - 1).drop("_n", "next_study")


def page_of_rows(rows: DataFrame, page: int = 1, size: int = 100, document: int | None = None, after: int | None = None, max_size: int | None = None) -> DataFrame:
    """One page by study, with the total of the filter on every row.

    With ``after``, the last study of the page before, the page is found by that key and no earlier row is kept; a page number
    keeps all rows before it. ``max_size`` refuses larger pages.
    """
    if page < 1 or size < 1 or (max_size is not None and size > max_size):
        raise ValueError("page or size out of range")
    chosen = rows if document is None else rows.filter(F.col("document") == document)
    total = chosen.agg(F.count("*"))
    ordered = chosen.orderBy("study").offset((page - 1) * size) if after is None else chosen.filter(F.col("study") > after).orderBy("study")
    return ordered.limit(size).withColumn("total", total.scalar())


def row_by_study(rows: DataFrame, project_id: str, study: int) -> DataFrame:
    return rows.filter((F.col("project_id") == project_id) & (F.col("study") == study))


def cell_by_key(cells: DataFrame, project_id: str, study: int, key: str) -> DataFrame:
    return row_by_study(cells, project_id, study).filter(F.col("key") == key)


def mark_outdated(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Extracted rows coded with another codebook than the active one become outdated; the flag never falls back."""
    joined = rows.join(active.select("project_id", F.col("codebook_id").alias("_active")), "project_id", "left")
    other = (F.col("origin") == "EXTRAIDA") & F.col("_active").isNotNull() & ~F.col("codebook_id").eqNullSafe(F.col("_active"))
    return joined.withColumn("outdated", F.col("outdated") | other).drop("_active")


# ------------------------------------------------------------------ flags, marks and queues
def cell_summary(cells: DataFrame, discrepancies: DataFrame, findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Short view of each cell; the side tables carry project_id, study and key (or column)."""

    def flag(side: DataFrame, name: str) -> DataFrame:
        return side.select(*CELL_KEY).distinct().withColumn(name, F.lit(True))

    pending = findings.filter(F.col("state").isin("PENDIENTE", "Pendiente"))
    out = cells
    for side, name in ((discrepancies, "discrepancy"), (pending, "finding"), (notes, "inherited_note")):
        out = out.join(flag(side, name), CELL_KEY, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def mark() -> Column:
    """Mark of a summarised cell; the first condition that holds decides."""
    state = F.col("review_state")
    return (
        F.when(state.isin(REVIEWED), "verde")
        .when(state.isin("RECHAZADA", "NO_VERIFICABLE") | F.col("finding"), "rojo")
        .when(F.col("discrepancy"), "naranja")
        .when(state == "POR_CONFIRMAR", "amarillo-borde")
        .when(F.col("value_type").eqNullSafe("INFERIDO"), "amarillo")
        .when(state == "SIN_EVIDENCIA", "gris")
        .otherwise("ninguno")
    )


def mark_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("mark").agg(F.count("*").alias("n"))


def rows_with_marks(marked: DataFrame, marks: list[str]) -> DataFrame:
    """Rows that hold at least one cell with a chosen mark; without a choice, all rows."""
    chosen = marked if not marks else marked.filter(F.col("mark").isin(marks))
    return chosen.select("project_id", "study").distinct()


def columns_with_marks(marked: DataFrame, marks: list[str]) -> DataFrame:
    return marked.filter(F.col("mark").isin(marks)).select("project_id", "key").distinct()


def rows_of_articles(marked: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows that belong to the chosen articles."""
    return marked.select("project_id", "study", "article_id").distinct().join(articles, ["project_id", "article_id"], "left_semi")


def mark_priority(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in MARK_PRIORITY.items() for x in pair])
    return F.try_element_at(pairs, c)


def review_queue(marked: DataFrame) -> DataFrame:
    """Cells still to review, with their ``rank`` in their project: most urgent mark first, then by row and column.

    Ranks come from sampled ranges of (project, order), so a project with most cells is dealt over many tasks and nothing is sorted as a whole.
    """
    open_ = marked.filter(
        (F.col("origin") == "EXTRAIDA") & ~F.col("review_state").isin(REVIEWED)
        & (~is_null(F.col("value")) | (F.col("evidence_count") > 0)))
    return _ranked(open_.withColumn("priority", mark_priority(F.col("mark"))), ["priority", "study", "position", "key"])


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, the place of a row in its project by ``order``."""
    by = [F.col(c) for c in order]
    dealt = in_ranges(rows, [F.col("project_id"), *by])
    return ranged_sums(dealt, ["project_id"], by, {"rank": F.lit(1)}).drop("_range")


def pending_cells(marked: DataFrame) -> DataFrame:
    """Cells the keyboard walks through, with their ``rank`` in reading order: extracted, not reviewed, not inherited."""
    open_ = marked.filter((F.col("origin") == "EXTRAIDA") & ~F.col("review_state").isin(REVIEWED) & (F.col("mark") != "gris"))
    return _ranked(open_, ["study", "position", "key"])


def related_inferences(cells: DataFrame, inferences: DataFrame, trace_fields: DataFrame) -> DataFrame:
    """Inferences of the row that name the column or one of its trace fields, without the cell's own.

    ``inferences``: project_id, study, name, reasoning. ``trace_fields``: project_id, key, fields (array).
    """
    own = cells.join(trace_fields, ["project_id", "key"], "left").select(
        *CELL_KEY, F.coalesce("fields", F.array().cast("array<string>")).alias("_fields"), F.col("inference.reasoning").alias("_own"))
    joined = own.join(inferences, ["project_id", "study"])
    named = F.contains("name", F.col("key")) | F.exists("_fields", lambda f: F.contains(F.col("name"), f))
    same = (F.coalesce("reasoning", F.lit("")) != "") & F.col("reasoning").eqNullSafe(F.col("_own"))
    return joined.filter(named & ~same).select(*CELL_KEY, "name", "reasoning")


def category_meanings(cells: DataFrame, meanings: DataFrame) -> DataFrame:
    """Meaning of each category of a cell; ``meanings``: project_id, key, category, meaning. Case does not count."""
    parts = cells.select(*CELL_KEY, F.posexplode(F.split(cell_text(F.col("value")), "; ")).alias("part_no", "part"))
    named = meanings.select("project_id", "key", "category", "meaning", F.lower("category").alias("_low"))
    joined = parts.withColumn("_low", F.lower("part")).join(named, ["project_id", "key", "_low"])
    best = joined.groupBy(*CELL_KEY, "part_no", "part").agg(F.min("category").alias("category"), F.min_by("meaning", "category").alias("meaning"))
    return best


def document_lookups(rows: DataFrame) -> DataFrame:
    """Document of each article that has rows: that of the last row seen."""
    return rows.filter("article_id is not null").groupBy("project_id", "article_id").agg(F.max_by("document", "study").alias("document"))


def covidence_lookup(cells: DataFrame) -> DataFrame:
    """Last positive whole Covidence number seen per document."""
    own = cells.filter(F.col("key") == COVIDENCE).withColumn("_n", F.coalesce(whole_number(F.col("value")), F.col("value.str").try_cast("bigint")))
    return own.filter("_n > 0").groupBy("project_id", "document").agg(F.max_by("_n", "study").alias("covidence"))
