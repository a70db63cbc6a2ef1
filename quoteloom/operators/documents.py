"""Converter output to ordered blocks, and the reports and texts that come straight from blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.fuzzy import partial_ratio_udf
from quoteloom.functions.grid import grid_of, html_runs_udf
from quoteloom.functions.text import as_col, bind, blank, join_lines, norm, unescape
from quoteloom.operators.ordering import running_sum
from quoteloom.vocab import BBOX_SCALE, BLOCK_ID_PATTERN, BLOCK_TYPE_BY_ITEM, BLOCK_TYPES

DOC = ["project_id", "doc_id"]
BLOCK = [*DOC, "block_id"]
NO_CITED_BLOCKS = "(sin bloques citados)"


# ------------------------------------------------------------------ blocks from items
def block_type(item_type: Column | str, text_level: Column | str) -> Column:
    """Block type of a converter item; ``text`` is a title when it carries a level."""
    known = F.create_map(*[F.lit(x) for pair in BLOCK_TYPE_BY_ITEM.items() for x in pair])
    return F.when(
        as_col(item_type) == "text",
        F.when(F.coalesce(as_col(text_level), F.lit(0)) != 0, "titulo").otherwise("parrafo"),
    ).otherwise(F.coalesce(F.try_element_at(known, F.coalesce(as_col(item_type), F.lit(""))), F.lit("otro")))


def block_id(page: Column | str, ordinal: Column | str) -> Column:
    return F.format_string("p%02d-b%02d", as_col(page), as_col(ordinal))


def scaled_rect(bbox: Column | str, width: Column | str, height: Column | str) -> Column:
    """Rectangle in points from the 0–1000 box of the converter."""
    b = as_col(bbox)

    def side(i: int, extent: Column | str) -> Column:
        return F.bround(b[i] / BBOX_SCALE * as_col(extent), 2)

    return F.struct(
        side(0, width).alias("x0"), side(1, height).alias("y0"), side(2, width).alias("x1"), side(3, height).alias("y1")
    )


def _lines(*parts: Column) -> Column:
    """Array parts joined by line breaks, empty ones dropped."""
    empty = F.array().cast("array<string>")
    return F.array_join(F.filter(F.concat(*[F.coalesce(p, empty) for p in parts]), lambda x: x != ""), "\n")


def item_text(kind: Column, grid: Column) -> Column:
    """Text of a block according to the kind of its item."""
    grid_rows = F.transform(grid, lambda row: F.array_join(row, " "))

    def figure(prefix: str) -> Column:
        return _lines(
            F.col(f"{prefix}_caption"), F.array(F.coalesce(F.col("content"), F.lit(""))), F.col(f"{prefix}_footnote")
        )

    return (
        F.when(kind == "table", _lines(F.col("table_caption"), grid_rows, F.col("table_footnote")))
        .when(kind == "list", F.coalesce(F.array_join("list_items", "\n"), F.lit("")))
        .when(kind == "image", figure("image"))
        .when(kind == "chart", figure("chart"))
        .otherwise(F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("content"), F.lit("")))
    )


def cells_of_grid(grid: Column) -> Column:
    """Body cells with text, labelled by the first column of the row and the header row of the column."""
    return bind(grid, _labelled_cells)


def _labelled_cells(grid: Column) -> Column:
    header = F.get(grid, F.lit(0))
    body = F.transform(
        grid,
        lambda row, i: F.transform(
            row,
            lambda text, j: F.struct(
                i.alias("row"), j.alias("col"), text.alias("text"),
                F.get(row, F.lit(0)).alias("row_label"), F.get(header, j).alias("col_label"),
            ),
        ),
    )
    return F.filter(F.flatten(body), lambda c: (c["row"] > 0) & (c["col"] > 0) & (c["text"] != ""))


def blocks_from_items(items: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per block. Items on unknown pages or without a box leave before blocks are numbered."""
    placed = (
        items.withColumn("page", F.col("page_idx") + 1)
        .filter(F.col("bbox").isNotNull())
        .join(pages.select(*DOC, "page", "width_pt", "height_pt"), [*DOC, "page"])
    )
    per_page = Window.partitionBy(*DOC, "page").orderBy("pos")
    kind = F.coalesce(F.col("type"), F.lit(""))
    numbered = (
        placed.withColumn("ord", F.row_number().over(per_page))
        .withColumn("_runs", html_runs_udf(F.when(F.col("type") == "table", F.col("table_body"))))
        .withColumn("grid", grid_of(F.col("_runs")))
        .withColumn("block_id", block_id("page", "ord"))
        .withColumn("block_type", block_type("type", "text_level"))
    )
    return (
        numbered.withColumn("block_text", item_text(kind, F.col("grid")))
        .select(
            *DOC, "pos", "page", "ord", "block_id",
            F.col("block_type").alias("type"),
            scaled_rect("bbox", "width_pt", "height_pt").alias("rect"),
            F.col("block_text").alias("text"),
            norm("block_text").alias("text_norm"),
            (F.col("block_type") == "tabla").alias("is_table"),
            ((F.col("block_type") == "figura") | ((F.col("block_type") == "tabla") & F.col("grid").isNull())).alias("is_image"),
            "grid",
            cells_of_grid(F.col("grid")).alias("cells"),
            F.col("img_path").alias("image"),
        )
    )


def table_cells(blocks: DataFrame) -> DataFrame:
    """Exploded body cells of every table block."""
    return blocks.filter("is_table").select(*BLOCK, F.explode("cells").alias("c")).select(*BLOCK, "c.*")


def table_grid(tables: DataFrame, html: str = "html") -> DataFrame:
    """Cells of HTML tables, one row per place of the grid; the other columns are kept. Runs of columns are expanded here."""
    kept = [c for c in tables.columns if c != html]
    rows = tables.select(*kept, F.posexplode(html_runs_udf(F.col(html))).alias("row", "_runs"))
    runs = rows.select(*kept, "row", F.explode("_runs").alias("_r"))
    return runs.select(*kept, "row", F.explode(F.sequence(F.col("_r.c0"), F.col("_r.c1") - 1)).alias("col"), F.col("_r.text").alias("text"))


# ------------------------------------------------------------------ audits
def integrity_violations(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Broken blocks, one row per problem: repeated id, missing page, bad id, unknown type, inverted rectangle."""
    repeated = (
        blocks.groupBy(*BLOCK).count().filter("count > 1").select(*BLOCK, F.lit("repeated id").alias("violation"))
    )
    no_page = (
        blocks.join(pages.select(*DOC, "page"), [*DOC, "page"], "left_anti")
        .select(*BLOCK, F.lit("missing page").alias("violation"))
    )
    id_page = F.regexp_extract("block_id", r"^p(\d{2,})-b(\d{2,})$", 1).try_cast("int")
    own = F.array_compact(
        F.array(
            F.when(id_page.isNull() | (id_page != F.col("page")), F.lit("bad id")),
            F.when(~F.col("type").isin(BLOCK_TYPES), F.lit("unknown type")),
            F.when((F.col("rect.x1") < F.col("rect.x0")) | (F.col("rect.y1") < F.col("rect.y0")), F.lit("inverted rectangle")),
        )
    )
    own_rows = blocks.select(*BLOCK, F.explode(own).alias("violation"))
    return repeated.unionByName(no_page).unionByName(own_rows)


def sparse_text_pages(blocks: DataFrame, pages: DataFrame, minimum: int = 200) -> DataFrame:
    """Pages whose selectable text is shorter than the minimum."""
    chars = blocks.groupBy(*DOC, "page").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"))
    return (
        pages.select(*DOC, "page").join(chars, [*DOC, "page"], "left")
        .select(*DOC, "page", F.coalesce("chars", F.lit(0)).alias("chars"))
        .filter(F.col("chars") < minimum)
    )


def image_pages(blocks: DataFrame) -> DataFrame:
    """Distinct pages that hold a figure or a table in an image, sorted, per document."""
    return (
        blocks.filter("is_image").select(*DOC, "page").distinct()
        .groupBy(*DOC).agg(F.array_sort(F.collect_list("page")).alias("pages"))
    )


def rect_check(blocks: DataFrame, clips: DataFrame, ok_from: float = 90.0, head_chars: int | None = None) -> DataFrame:
    """Similarity of each text block, or its first ``head_chars`` characters, with the text clipped at its rectangle and at a shifted control."""
    plain = norm(F.regexp_replace("text", r"</?su[bp]>|\$[^$]*\$", " "))
    texts = (
        blocks.filter(~F.col("type").isin("figura", "tabla"))
        .select(*BLOCK, "type", plain.alias("_plain"))
        .join(clips.select(*BLOCK, norm("clip").alias("_clip"), norm("shifted").alias("_shifted")), BLOCK, "left")
    )
    head = F.col("_plain") if head_chars is None else F.substr(F.col("_plain"), F.lit(1), F.lit(head_chars))
    cut = texts.withColumn("_head", head)
    # a row without two texts gives the Python function a null, which it does not score
    given = {n: F.when((F.col("_head") != "") & (F.col(c) != ""), F.col("_head")) for n, c in (("_s", "_clip"), ("_c", "_shifted"))}
    scored = cut.withColumns({"_s": partial_ratio_udf(given["_s"], "_clip"), "_c": partial_ratio_udf(given["_c"], "_shifted")})
    both = scored.groupBy(*BLOCK, "type", "_plain").agg(F.max("_s").alias("_s"), F.max("_c").alias("_c"))
    empty = F.col("_plain") == ""
    return both.select(
        *BLOCK, "type",
        F.when(~empty, F.bround("_s", 1)).alias("similarity"),
        F.when(empty, "SIN_TEXTO").when(F.col("_s") >= ok_from, "OK").otherwise("REVISAR").alias("state"),
        F.when(~empty, F.bround("_c", 1)).alias("control_similarity"),
    )


def rect_check_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(*DOC).pivot("state", ["OK", "REVISAR", "SIN_TEXTO"]).count().na.fill(0)


# ------------------------------------------------------------------ text seen by the coder
def needs_layer() -> Column:
    """Blocks whose text must come from the text layer: empty, or with formula marks."""
    return ~F.col("is_table") & (F.col("type") != "figura") & (blank("text") | F.col("text").contains("$"))


def effective_blocks(blocks: DataFrame, layer: DataFrame | None = None) -> DataFrame:
    """Adds ``shown`` (text as the coder saw it; null when skipped) and ``effective_norm`` (its comparable form)."""
    if layer is None:
        joined = blocks.withColumn("layer_text", F.lit(None).cast("string"))
    else:
        joined = blocks.join(layer.select(*BLOCK, "layer_text"), BLOCK, "left")
    source = F.when(needs_layer(), F.coalesce("layer_text", F.lit(""))).otherwise(F.col("text"))
    plain = unescape(join_lines(source))
    shown = (
        F.when(F.col("is_table"), unescape("text"))
        .when(F.col("type") == "figura", unescape(join_lines("text")))
        .otherwise(F.nullif(plain, F.lit("")))
    )
    out = joined.withColumn("shown", shown).drop("layer_text")
    return out.withColumn("effective_norm", norm(F.coalesce("shown", F.lit(""))))


def anchor_variants() -> Column:
    """The two comparable texts of a block, what the coder saw first, without repeats or empties."""
    both = F.array(F.coalesce("effective_norm", F.lit("")), F.coalesce("text_norm", F.lit("")))
    return F.filter(F.array_distinct(both), lambda t: t != "")


def labelled_lines(blocks: DataFrame) -> DataFrame:
    """Labelled lines of effective blocks: ``[id | type] text``; tables give captions, cells and notes.

    ``sub`` orders the lines inside their block.
    """
    numbered = running_sum(blocks, DOC, "pos", F.col("is_table").cast("long"), "table_no")
    tag = F.format_string("[%s | tabla | Tabla %s]", F.col("block_id"), F.col("table_no"))
    grid_rows = F.transform(F.coalesce("grid", F.array().cast("array<array<string>>")), lambda row: F.array_join(row, " "))
    every = F.filter(F.split("text", "\n"), lambda ln: ln != "")

    def table_lines(tag_: Column, rows: Column, lines_: Column) -> Column:
        free = F.filter(lines_, lambda ln: ~F.array_contains(rows, ln))
        first_row = F.array_position(F.transform(lines_, lambda ln: F.array_contains(rows, ln)), True)
        captions = F.when(first_row > 0, (first_row - 1).cast("int")).otherwise(F.size(lines_))
        cell_lines = F.transform(
            "cells",
            lambda c: F.concat(
                tag_, F.lit(' fila "'), c["row_label"], F.lit('" | columna "'), c["col_label"], F.lit('" = "'), c["text"], F.lit('"')
            ),
        )
        return F.concat(
            F.transform(F.slice(free, F.lit(1), captions), lambda ln: F.concat(tag_, F.lit(" leyenda: "), ln)),
            cell_lines,
            F.transform(F.slice(free, captions + 1, F.size(free)), lambda ln: F.concat(tag_, F.lit(" nota: "), ln)),
        )

    of_table = bind(
        F.struct(tag.alias("tag"), grid_rows.alias("rows"), every.alias("lines")),
        lambda x: table_lines(x["tag"], x["rows"], x["lines"]),
    )
    in_image = F.array(F.concat(tag, F.format_string(" (tabla en imagen; ver página %s en PNG)", F.col("page"))))
    figure = F.array(
        F.format_string("[%s | figura | imagen] %s (ver página %s en PNG)", F.col("block_id"),
                        F.coalesce(F.nullif("shown", F.lit("")), F.lit("(sin texto)")), F.col("page"))
    )
    plain = F.when(
        F.col("shown").isNotNull(), F.array(F.format_string("[%s | %s] %s", F.col("block_id"), F.col("type"), F.col("shown")))
    )
    lines = (
        F.when(F.col("is_table") & F.col("is_image"), F.transform(in_image, unescape))
        .when(F.col("is_table"), F.transform(of_table, unescape))
        .when(F.col("type") == "figura", figure)
        .otherwise(plain)
    )
    return numbered.select(*DOC, "pos", "page", "block_id", F.posexplode(lines).alias("sub", "line"))


def labelled_text(lines: DataFrame) -> DataFrame:
    """The labelled text of each document as one string, in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sub", "line")))
    return lines.groupBy(*DOC).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def cited_blocks(sources: DataFrame, lines: DataFrame, json_col: str = "json") -> DataFrame:
    """Lines of the blocks named anywhere in each source's JSON, sorted by id; a fixed text when there is none.

    ``sources`` keeps its own columns and must carry project, document and ``source_id``.
    """
    ids = F.array_distinct(F.regexp_extract_all(F.col(json_col), F.lit(BLOCK_ID_PATTERN), F.lit(0)))
    wanted = sources.select(*DOC, "source_id", F.explode(ids).alias("block_id"))
    of_block = (
        lines.groupBy(*BLOCK)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "line"))), lambda x: x["line"]), "\n").alias("line"))
    )
    texts = (
        wanted.join(of_block, BLOCK)
        .groupBy(*DOC, "source_id")
        .agg(F.array_sort(F.collect_list(F.struct("block_id", "line"))).alias("_found"))
        .select(*DOC, "source_id", F.array_join(F.transform("_found", lambda x: x["line"]), "\n").alias("_text"))
    )
    return (
        sources.join(texts, [*DOC, "source_id"], "left")
        .withColumn("cited", F.coalesce("_text", F.lit(NO_CITED_BLOCKS)))
        .drop("_text")
    )


def quote_fragments(fragments: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fragments of a page text layer that a quote covers, word breaks at line ends tolerated.

    ``fragments``: project, document, page, pos, text. ``quotes``: project, document, page, quote_id, quote.
    """
    page_key = [*DOC, "page"]
    normed = fragments.withColumn("_t", norm("text")).filter("_t <> ''")
    upto = Window.partitionBy(*page_key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        normed.withColumn("_end", F.sum(F.char_length("_t") + 1).over(upto) - 1)
        .withColumn("_start", F.col("_end") - F.char_length("_t"))
        .select(*page_key, "pos", "_start", "_end", "_t")
    )
    page_text = placed.groupBy(*page_key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), " ").alias("_page_text")
    )
    found = (
        quotes.withColumn("_q", norm("quote")).filter("_q <> ''").join(page_text, page_key)
        .withColumn("_at", F.expr("locate(_q, _page_text)") - 1)
        .withColumn("_joined", F.replace(F.col("_page_text"), F.lit("- "), F.lit("")))
        .withColumn("_at_joined", F.when(F.col("_at") < 0, F.expr("locate(_q, _joined)") - 1))
        .filter((F.col("_at") >= 0) | (F.col("_at_joined") >= 0))
    )
    lens = F.transform(F.split("_page_text", "- "), lambda p: F.char_length(p))

    def original(joined_at: Column) -> Column:
        """Place in the page text of a place in the text without breaks: two characters per break before it."""

        def shift(at: Column) -> Column:
            passed = F.aggregate(
                lens,
                F.struct(F.lit(0).alias("len"), F.lit(0).alias("n")),
                lambda acc, ln: F.when(
                    acc["len"] + ln <= at, F.struct((acc["len"] + ln).alias("len"), (acc["n"] + 1).alias("n"))
                ).otherwise(F.struct(F.lit(1 << 30).alias("len"), acc["n"].alias("n"))),
            )
            return at + 2 * passed["n"]

        return bind(joined_at, shift)

    direct = F.col("_at") >= 0
    spans = found.select(
        *page_key, "quote_id",
        F.when(direct, F.col("_at")).otherwise(original(F.col("_at_joined"))).alias("_from"),
        F.when(direct, F.col("_at") + F.char_length("_q"))
        .otherwise(original(F.col("_at_joined") + F.char_length("_q") - 1) + 1).alias("_to"),
    )
    return (
        spans.join(placed, page_key)
        .filter((F.col("_end") > F.col("_from")) & (F.col("_start") < F.col("_to")))
        .select(*page_key, "quote_id", "pos")
    )
