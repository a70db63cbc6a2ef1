"""Where each quote of a coding stands in its document, with a graded level.

The cascade is: table cell by its labels, literal in the cited block, literal elsewhere in the document,
approximate on the cited page and its neighbours, read from a figure, not verifiable. Exact steps run first
and each later step sees only the distinct quotes still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.fuzzy import best_in_batches, labels_match_udf
from quoteloom.functions.text import as_col, bind, norm
from quoteloom.operators.documents import BLOCK, DOC, anchor_variants
from quoteloom.operators.spread import BROADCAST_BYTES, hot_buckets, spread_join
from quoteloom.session import cut_lineage
from quoteloom.vocab import ANCHOR_LEVELS, FUZZY_THRESHOLD, STATE_BY_LEVEL, STUDY

EVIDENCE_KEY = ["project_id", "extraction_id", "row_pos", "column", "ev_idx"]
ANCHOR_COLUMNS = [
    *EVIDENCE_KEY, "doc_id", "study", "level", "similarity", "block_id", "page", "rect", "range", "figure", "note",
]


# ------------------------------------------------------------------ evidence of a coding
def study_number(cell: Column, row_pos: Column | str) -> Column:
    """Study of a row; a missing, textual or boolean study falls back to the negative place of the row."""
    numeric = cell["kind"].isin("int", "float")
    return F.coalesce(F.when(numeric, cell["num"].cast("bigint")), -(as_col(row_pos) + 1))


def evidence_of(rows: DataFrame) -> DataFrame:
    """One row per evidence of coded rows (rows × columns × evidences)."""
    per_column = rows.select(
        "project_id", "extraction_id", "doc_id", "row_pos",
        study_number(F.col("fila")[STUDY], "row_pos").alias("study"),
        F.explode("traz.evidencia").alias("column", "_list"),
    )
    each = per_column.select(*[c for c in per_column.columns if c != "_list"], F.posexplode("_list").alias("ev_idx", "_e"))
    return each.filter("_e is not null").select(
        "project_id", "extraction_id", "doc_id", "row_pos", "study", "column", "ev_idx",
        F.col("_e.pagina_pdf").alias("page_hint"),
        F.col("_e.cita_textual").alias("quote"),
        F.col("_e.fila_tabla").alias("table_row"),
        F.col("_e.columna_tabla").alias("table_col"),
        F.coalesce("_e.leido_de_figura", F.lit(False)).alias("figure"),
        F.col("_e.bloque_id").alias("block_id"),
    )


# ------------------------------------------------------------------ literal search by rare keys
#: Keys that are counted for each quote, of which the rarest is searched for.
KEYS = 3


def _longest(parts: Column) -> Column:
    """Distinct parts, the longest first."""
    return F.array_sort(F.array_distinct(F.transform(parts, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))))["w"]


def quote_keys(q: Column | str) -> Column:
    """Up to KEYS keys (kind, key) of a quote; every text that contains it also has each of them.

    The first and last words of a quote may be parts of longer words; those between are whole, so the longest of them are its
    keys. Quotes of one or two words are keyed by runs of three characters inside their longer word, or by a word of one or two.
    """

    def choose(words: Column) -> Column:
        inner = F.slice(_longest(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))), 1, KEYS)
        piece = F.get(_longest(words), F.lit(0))
        n = F.char_length(piece)
        runs = F.array_distinct(F.transform(F.array(F.lit(1), F.ceil((n - 1) / 2).cast("int"), n - 2), lambda at: F.substr(piece, at, F.lit(3))))

        def keys(kind: str, texts: Column) -> Column:
            return F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

        return F.when(F.size(words) >= 3, keys("word", inner)).when(n >= 3, keys("three", runs)).otherwise(keys("short", F.array(piece)))

    return bind(F.split(as_col(q), " "), choose)


def _runs(text: Column, size: int, of: str = r"\S") -> Column:
    """All runs of ``size`` characters inside the words of a text (or of any characters), in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({of}{{{size}}}))"), F.lit(1))


def _text_keys(kind: str) -> Column:
    """Distinct keys of one kind of the texts in ``variants``."""
    of = {
        "word": lambda t: F.split(t, " "),
        "three": lambda t: _runs(t, 3),
        "short": lambda t: F.concat(_runs(t, 1), _runs(t, 2)),
        "any": lambda t: F.concat(_runs(t, 1, "."), _runs(t, 2, ".")),
    }
    return F.array_distinct(F.flatten(F.transform("variants", of[kind])))


def _hit(q: Column) -> Column:
    """First variant that contains the text, and where."""
    places = F.transform("variants", lambda t: F.call_function("locate", q, t))
    numbered = F.transform(places, lambda at, i: F.struct(i.alias("variant"), at.alias("at")))
    return F.get(F.filter(numbered, lambda x: x["at"] > 0), F.lit(0))


def _postings(asked: DataFrame, texts: DataFrame, scope: list[str], unit: list[str]) -> DataFrame:
    """(scope, unit, kind, key) of the asked keys alone. Kinds nobody asks for are not looked at, and a key that many texts of a
    scope have is dealt over tasks; which keys these are is told by a sample of the texts, which decides nothing else."""
    sizes = {r["_kind"]: r["n"] for r in asked.groupBy("_kind").agg(F.sum(F.octet_length("_key") + 64).alias("n")).collect()}  # three kinds at most
    every = texts.limit(0).select(*scope, *unit, F.lit("").alias("_kind"), F.lit("").alias("_key"))
    for kind in sorted(sizes):
        mine, small = asked.filter(F.col("_kind") == kind), sizes[kind] <= BROADCAST_BYTES
        # runs of characters are many, so only scopes that ask for some are read for them
        wanted = texts if kind == "word" or not scope else spread_join(texts, mine.select(*scope).distinct(), scope, unit, "left_semi")
        posted = wanted.select(*scope, *unit, F.lit(kind).alias("_kind"), F.explode(_text_keys(kind)).alias("_key"))
        hot = [] if small else hot_buckets(posted.filter(F.pmod(F.xxhash64(*unit), F.lit(16)) == 0), [*scope, "_kind", "_key"])
        found = posted.join(F.broadcast(mine), [*scope, "_kind", "_key"], "left_semi") if small else spread_join(posted, mine, [*scope, "_kind", "_key"], unit, "left_semi", hot, False)
        every = every.unionByName(found)
    return every


def locate_literal(quotes: DataFrame, texts: DataFrame, scope: list[str], unit: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Every (quote, text) pair in which the text contains the quote, inside the same scope.

    ``quotes``: scope and ``q``. ``texts``: scope, unit and ``variants`` (comparable texts of the unit). An inverted index of the
    asked keys alone proposes pairs: of the keys of a quote the one that fewest texts of its scope have, and none if the scope
    lacks one of them. ``contains`` checks the pairs, so the result is exact. Asked keys go to all tasks while they are few
    (counted in bytes); beyond that, frequent keys and texts are dealt over tasks. Returns scope, q, unit, the carried columns
    of the text, and ``variant`` and ``start`` of the first variant that has the quote.
    """
    key = [*scope, "_kind", "_key"]
    each = quotes.select(*scope, "q").filter("q <> ''").distinct().select(*scope, "q", F.explode(quote_keys("q")).alias("_k"))
    each = cut_lineage(each.select(*scope, "q", F.col("_k.kind").alias("_kind"), F.col("_k.key").alias("_key")))
    postings = cut_lineage(_postings(each.select(*key).distinct(), texts.select(*scope, *unit, "variants"), scope, unit))
    held = postings.groupBy(*key).agg(F.count("*").alias("_n"))
    rarest = spread_join(each, held, key, ["q"], "left").groupBy(*scope, "q").agg(
        F.min(F.coalesce("_n", F.lit(0))).alias("_least"), F.min(F.struct("_n", "_kind", "_key")).alias("_k"))
    chosen = cut_lineage(rarest.filter("_least > 0").select(*scope, "q", "_k._kind", "_k._key"))
    proposed = cut_lineage(spread_join(postings, chosen, key, unit).select(*scope, "q", *unit))
    met = spread_join(proposed, texts.select(*scope, *unit, *carry, "variants"), [*scope, *unit], ["q"], may_be_small=False)
    return (
        met.withColumn("_hit", _hit(F.col("q"))).filter("_hit is not null")
        .select(*scope, "q", *unit, *carry, F.col("_hit.variant").alias("variant"), (F.col("_hit.at") - 1).alias("start"))
    )


def first_in_document(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """First block of the document, in reading order, that contains each quote.

    Quotes of one or two characters stand in most blocks, so they are not paired with them: each block says which of the short
    texts it has, and the first of them is an aggregate.
    """
    asked = quotes.select(*DOC, "q").filter("q <> ''").distinct()
    short, long_ = asked.filter(F.char_length("q") <= 2), asked.filter(F.char_length("q") > 2)
    place = F.struct("block_id", "page", "rect", "start")
    pairs = locate_literal(long_, blocks, DOC, ["block_id"], ("pos", "page", "rect"))
    firsts = pairs.groupBy(*DOC, "q").agg(F.min_by(place, "pos").alias("found"))
    if not short.limit(1).count():
        return firsts
    asking = spread_join(blocks, short.select(*DOC).distinct(), DOC, ["pos"], "left_semi")
    said = asking.select(*DOC, "pos", "block_id", "page", "rect", "variants", F.explode(_text_keys("any")).alias("q"))
    of_all = said.withColumn("start", _hit(F.col("q"))["at"] - 1).filter("start is not null").groupBy(*DOC, "q").agg(F.min_by(place, "pos").alias("found"))
    return firsts.unionByName(of_all.join(short, [*DOC, "q"], "left_semi"))


# ------------------------------------------------------------------ approximate search near a page
def best_near_page(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Best partial ratio of each quote over the blocks of its page and the two next to it.

    ``quotes``: project, document, q, near_page. The earliest block, and its first text, win ties. The join is on (document,
    page), with the blocks of a frequent page dealt over tasks. Inside a batch, counts of characters and of pairs of
    characters bound each score from above: the most promising text of a quote is scored first, the others only where their
    bound reaches that score. Batches hand on one row per quote, so the rest of the best-of is a small aggregate.
    """
    three = F.explode(F.array(F.col("near_page") - 1, F.col("near_page"), F.col("near_page") + 1))
    asked = quotes.select(*DOC, "q", "near_page").distinct().withColumn("page", three)
    texts = blocks.select(*DOC, "page", "pos", "block_id", "rect", F.posexplode("variants").alias("variant", "t"))
    met = spread_join(texts, asked, [*DOC, "page"], ["pos", "variant"]).select(*DOC, "q", "near_page", "pos", "variant", "block_id", "page", "rect", "t")
    local = best_in_batches(met, [*DOC, "q", "near_page"], ["pos", "variant"])
    rank = F.struct(F.col("score"), -F.col("pos"), -F.col("variant"))
    return local.filter("score > 0").groupBy(*DOC, "q", "near_page").agg(F.max_by(F.struct("block_id", "page", "rect", "score"), rank).alias("best"))


# ------------------------------------------------------------------ the cascade
def norm_parts(parts: Column) -> Column:
    """norm() of each string of an array in one call."""
    mark = "\x01"
    return F.when(
        F.size(parts) > 0, F.transform(F.split(norm(F.array_join(F.transform(parts, lambda p: F.translate(p, mark, " ")), mark)), mark), lambda x: F.trim(x))
    )


def _cited(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence with its cited block: the literal place in it and whether a table cell carries quote and labels."""
    cited = blocks.select(
        *BLOCK,
        F.struct(F.col("block_id"), "page", "rect", "is_table", "is_image").alias("cited"),
        F.col("variants").alias("cited_variants"),
        F.when(F.col("is_table"), F.col("cells")).alias("cited_cells"),
    )
    joined = evidence.withColumn("q", norm(F.coalesce("quote", F.lit("")))).join(cited, BLOCK, "left")
    places = F.transform("cited_variants", lambda t: F.call_function("locate", F.col("q"), t))
    first = F.get(F.filter(places, lambda at: at > 0), F.lit(0))
    labels_given = (F.coalesce("table_row", F.lit("")) != "") & (F.coalesce("table_col", F.lit("")) != "")
    texts, rows, cols = (norm_parts(F.col(f"cited_cells.{f}")) for f in ("text", "row_label", "col_label"))
    carrying = F.filter(F.arrays_zip("_text", "_row", "_col"), lambda c: F.contains(c["_text"], F.col("q")))
    labelled = F.transform(carrying, lambda c: F.struct(c["_row"].alias("row_label"), c["_col"].alias("col_label")))
    candidates = F.when(labels_given & (F.col("q") != "") & (F.size(carrying) > 0), labelled)
    prepared = joined.withColumns({"_text": texts, "_row": rows, "_col": cols}).withColumn("_cands", candidates)
    return (
        prepared.withColumn("cell_hit", labels_match_udf("_cands", norm("table_row"), norm("table_col")))
        .withColumn("cited_start", F.when(F.col("q") != "", first - 1))
        .drop("cited_variants", "cited_cells", "_cands", "_text", "_row", "_col")
    )


def anchor(evidence: DataFrame, blocks: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Level, similarity and place of every evidence.

    ``evidence`` as given by :func:`evidence_of`; ``blocks`` as given by ``effective_blocks``.
    """
    blocks = blocks.withColumn("variants", anchor_variants())
    staged = cut_lineage(_cited(evidence, blocks))
    open_ = staged.filter("q <> '' and not cell_hit and cited_start is null")
    elsewhere = cut_lineage(first_in_document(open_.select(*DOC, "q"), blocks))
    near = F.coalesce(F.nullif("page_hint", F.lit(0)), F.col("cited.page"), F.lit(0))
    missing = (
        open_.withColumn("near_page", near).select(*DOC, "q", "near_page").distinct()
        .join(elsewhere, [*DOC, "q"], "left_anti")
    )
    close = best_near_page(missing, blocks)
    placed = (
        staged.withColumn("near_page", near)
        .join(elsewhere, [*DOC, "q"], "left")
        .join(close, [*DOC, "q", "near_page"], "left")
    )
    return _graded(placed, threshold)


def anchor_literal(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """The exact steps of the cascade alone; the level is null where only an approximate step could decide."""
    blocks = blocks.withColumn("variants", anchor_variants())
    staged = cut_lineage(_cited(evidence, blocks))
    open_ = staged.filter("q <> '' and not cell_hit and cited_start is null")
    elsewhere = first_in_document(open_.select(*DOC, "q"), blocks)
    placed = (
        staged.join(elsewhere, [*DOC, "q"], "left")
        .withColumn("near_page", F.lit(0))
        .withColumn("best", F.lit(None).cast("struct<block_id string, page int, rect struct<x0 double,y0 double,x1 double,y1 double>, score double>"))
    )
    graded = _graded(placed, FUZZY_THRESHOLD)
    return graded.withColumn("level", F.when(F.col("level").isin(ANCHOR_LEVELS[:2]), F.col("level")))


def _graded(placed: DataFrame, threshold: float) -> DataFrame:
    verified, corrected, confirm, none = ANCHOR_LEVELS
    in_cited = F.col("cell_hit") | F.col("cited_start").isNotNull()
    else_where = ~in_cited & F.col("found").isNotNull() & (F.col("q") != "")
    open_ = ~in_cited & ~else_where
    similar = open_ & (F.coalesce(F.col("best.score"), F.lit(0.0)) >= threshold)
    figure = open_ & ~similar & F.col("figure") & F.coalesce(F.col("cited.is_image"), F.lit(False))
    use_cited = in_cited | figure | (open_ & ~similar & F.col("cited").isNotNull())

    def place(field: str) -> Column:
        return (
            F.when(use_cited, F.col(f"cited.{field}"))
            .when(else_where, F.col(f"found.{field}"))
            .otherwise(F.col(f"best.{field}"))
        )

    start = F.when(~F.col("cell_hit") & F.col("cited_start").isNotNull(), F.col("cited_start")).when(
        else_where, F.col("found.start")
    )
    cell_hit = F.col("cell_hit")
    return placed.select(
        *EVIDENCE_KEY, "doc_id", "study",
        F.when(in_cited, verified).when(else_where, corrected).when(similar | figure, confirm).otherwise(none).alias("level"),
        F.when(in_cited | else_where, F.lit(100.0))
        .otherwise(F.bround(F.coalesce(F.col("best.score"), F.lit(0.0)), 1)).alias("similarity"),
        place("block_id").alias("block_id"),
        place("page").alias("page"),
        place("rect").alias("rect"),
        F.when(start.isNotNull(), F.struct(start.cast("int").alias("start"), (start + F.char_length("q")).cast("int").alias("end"))).alias("range"),
        "figure",
        F.when(cell_hit, "celda de tabla")
        .when(in_cited, "")
        .when(else_where, F.format_string("la cita está en %s, no en %s", F.col("found.block_id"), F.coalesce("block_id", F.lit("None"))))
        .when(similar, "coincidencia aproximada")
        .when(figure, "leído de figura: verificar a mano")
        .otherwise("").alias("note"),
    )


# ------------------------------------------------------------------ summaries and uses of anchors
def level_rank(level: Column | str) -> Column:
    """Place of a level from best (1) to worst; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in ANCHOR_LEVELS]), as_col(level)), F.lit(0))


def level_summary(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Count of anchors per level for each key, zero included."""
    counts = [F.count_if(F.col("level") == level).alias(level) for level in ANCHOR_LEVELS]
    return anchors.groupBy(*keys).agg(*counts)


def level_totals(anchors: DataFrame) -> DataFrame:
    """Count per level over all anchors, one row per level, zero included."""
    wide = anchors.agg(*[F.count_if(F.col("level") == level).alias(level) for level in ANCHOR_LEVELS])
    return wide.unpivot([], ANCHOR_LEVELS, "level", "n")


def worst_level(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Worst known level of each cell and the review state it opens with."""
    ranked = anchors.groupBy(*keys).agg(F.max(level_rank("level")).alias("_rank"))
    levels = F.array(*[F.lit(x) for x in ANCHOR_LEVELS])
    return ranked.select(
        *keys, F.get(levels, (F.col("_rank") - 1).cast("int")).alias("level")
    ).withColumn("review_state", initial_review_state("level"))


def initial_review_state(level: Column | str) -> Column:
    states = F.create_map(*[F.lit(x) for pair in STATE_BY_LEVEL.items() for x in pair])
    return F.coalesce(F.try_element_at(states, F.coalesce(as_col(level), F.lit(""))), F.lit("PENDIENTE"))


def attach_anchors(evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """Evidence with its anchor, by study, column and index; of rows sharing a study only the last receives it."""
    row_of_study = evidence.groupBy("project_id", "extraction_id", "study").agg(F.max("row_pos").alias("row_pos"))
    key = ["project_id", "extraction_id", "study", "column", "ev_idx"]
    latest = anchors.groupBy(*key).agg(
        F.max_by(F.struct("level", "similarity", F.col("block_id").alias("block_id"), "page", "rect", "range", "note"), "row_pos").alias("anchor")
    )
    targeted = latest.join(row_of_study, ["project_id", "extraction_id", "study"])
    return evidence.join(targeted, [*key, "row_pos"], "left")


def verified_rate(anchors: DataFrame, keys: list[str], minimum: float = 0.95) -> DataFrame:
    """Share of verified quotes per key and whether it reaches the minimum; quotes read from figures do not count."""
    good = F.col("level").isin(ANCHOR_LEVELS[:2])
    return (
        anchors.filter("not figure").groupBy(*keys)
        .agg(F.count("*").alias("quotes"), F.count_if(good).alias("verified"))
        .withColumn("rate", F.col("verified") / F.col("quotes"))
        .withColumn("accepted", F.col("rate") >= minimum)
    )


def anchor_keys(evidence: DataFrame) -> DataFrame:
    """Evidence that names a block, as ``row|column|index`` keys."""
    return evidence.filter("block_id is not null").select(
        "project_id", "extraction_id",
        F.concat_ws("|", F.col("row_pos").cast("string"), "column", F.col("ev_idx").cast("string")).alias("key"),
        "block_id",
    )


def merge_anchor_keys(evidence: DataFrame, keyed: DataFrame) -> DataFrame:
    """Fills the block of evidence that lacks one from ``row|column|index`` keys."""
    pattern = r"^(\d+)\|(.*)\|(\d+)$"
    parts = keyed.select(
        "project_id", "extraction_id",
        F.regexp_extract("key", pattern, 1).cast("int").alias("row_pos"),
        F.regexp_extract("key", pattern, 2).alias("column"),
        F.regexp_extract("key", pattern, 3).cast("int").alias("ev_idx"),
        F.col("block_id").alias("_from_key"),
    )
    return evidence.join(parts, EVIDENCE_KEY, "left").withColumn("block_id", F.coalesce("block_id", "_from_key")).drop("_from_key")
