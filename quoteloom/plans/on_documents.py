"""Queries on documents, text and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.canonical import response_objects
from quoteloom.functions.text import bind, join_lines, norm, numbers_in, unescape, word_count
from quoteloom.operators import anchoring, documents as docs, passages
from quoteloom.plans.derived import BLOCKS, EVIDENCE, ITEMS, blocks, evidence, items, pages, shown_blocks, sql_norm, stored_blocks
from quoteloom.plans.registry import Tables, query
from quoteloom.session import cut_lineage, shared_folder
from quoteloom.sources.converter import converter_items, converter_pages, read_converter_folder, rejected_outputs
from quoteloom.sources.sinks import write_files


# ------------------------------------------------------------------ blocks
@query("blocks_from_items", f"""WITH {BLOCKS}
SELECT project_id, doc_id, CAST(pos AS BIGINT) AS pos, CAST(page AS BIGINT) AS page, block_id, type,
  round((50.0 + 10.0 * (pos % 7)) / 1000 * width_pt, 2) AS x0, round((250.0 + 200.0 * (pos % 4)) / 1000 * 842.0, 2) AS y1,
  sha256(text) AS text_hash, text_norm, is_table, is_image FROM blocks""")
def blocks_from_items(t: Tables) -> DataFrame:
    return blocks(t).select("project_id", "doc_id", "pos", "page", "block_id", "type", F.round("rect.x0", 2).alias("x0"),
                            F.round("rect.y1", 2).alias("y1"), F.sha2("text", 256).alias("text_hash"), "text_norm", "is_table", "is_image")


@query("converter_output", f"""WITH {ITEMS}, widths AS (SELECT project_id, doc_id, sum(width_pt) AS width FROM
  (SELECT DISTINCT project_id, doc_id, page_idx, 595.0 + 10.0 * (page_idx % 3) AS width_pt FROM items) GROUP BY ALL)
SELECT i.project_id, i.doc_id, count(*) AS items, sum(length(line))::BIGINT AS chars, CAST(round(any_value(width), 2) AS DOUBLE) AS width FROM items i JOIN widths USING (project_id, doc_id) GROUP BY ALL""")
def converter_output(t: Tables) -> DataFrame:
    """Items and page sizes written as the converter's two files in a folder for each document, and the folders read back."""
    its, folder = items(t), shared_folder(t.spark)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct("page_idx", "type", "bbox", F.col("line").alias("text")).alias("i"))))
    page = F.struct("page_idx", F.array(595.0 + 10.0 * (F.col("page_idx") % 3), F.lit(842.0)).alias("page_size"))
    whole = its.groupBy("project_id", "doc_id").agg(
        F.to_json(F.transform(ordered, lambda x: x["i"])).alias("content_list"), F.to_json(F.struct(F.collect_set(page).alias("pdf_info"))).alias("middle"))
    parts = F.explode(F.array(*(F.struct(F.lit(f"{n}.json").alias("file"), F.col(n).alias("content")) for n in ("content_list", "middle"))))
    write_files(whole.select("project_id", "doc_id", parts.alias("p")).select(F.concat_ws("/", "project_id", "doc_id", "p.file").alias("path"), "p.content"), folder)
    raw = cut_lineage(read_converter_folder(t.spark, folder))
    read = converter_items(raw).groupBy("project_id", "doc_id").agg(F.count("*").alias("items"), F.sum(F.char_length("text")).alias("chars"))
    widths = converter_pages(raw).groupBy("project_id", "doc_id").agg(F.round(F.sum("width_pt"), 2).alias("width"))
    return read.join(widths, ["project_id", "doc_id"])


@query("converter_rejects", """SELECT lang AS project_id, CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN n_chars < 500 THEN 0 ELSE 1 END::BIGINT AS pages FROM documents""")
def converter_rejects(t: Tables) -> DataFrame:
    """Documents with a missing part go to the reject table, the others give their pages."""
    raw = t.documents.select(
        F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("[]").alias("content_list"),
        F.when(F.col("n_chars") >= 500, F.lit('{"pdf_info": [{"page_idx": 0, "page_size": [595.0, 842.0]}]}')).alias("middle"))
    good = converter_pages(raw).groupBy("project_id", "doc_id").agg(F.count("*").alias("pages"))
    return good.unionByName(rejected_outputs(raw).select("project_id", "doc_id", F.lit(0).cast("bigint").alias("pages")))


@query("table_cells", f"""WITH {BLOCKS}, words AS (SELECT project_id, doc_id, block_id, string_split(line, ' ') AS w FROM blocks WHERE is_table),
cells AS (SELECT project_id, doc_id, block_id, unnest(range(1, len(w))) AS col, w FROM words)
SELECT project_id, doc_id, block_id, CAST(1 AS BIGINT) AS "row", col, w[col + 1] AS text, w[1] AS row_label, w[col + 1] AS col_label
FROM cells WHERE w[col + 1] <> ''""")
def table_cells(t: Tables) -> DataFrame:
    return docs.table_cells(blocks(t))


@query("html_lists_grid", r"""WITH tables AS (
  SELECT page_id, regexp_replace(regexp_replace(list_aggregate(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 'string_agg', chr(1)), '<[^>]*>', '', 'g'), ' +', ' ', 'g') AS body FROM pages),
rows AS (SELECT page_id, string_split(body, chr(1)) AS r FROM tables WHERE body IS NOT NULL)
SELECT page_id, unnest(range(0, len(r))) AS "row", CAST(0 AS BIGINT) AS col, trim(unnest(r)) AS text FROM rows""")
def html_lists_grid(t: Tables) -> DataFrame:
    """Navigation lists of web pages as one-column tables, through the grid of an HTML table."""
    entries = F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
    rows = F.array_join(F.transform(entries, lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td></tr>"))), "")
    tables = t.read("pages").select("page_id", F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"))
    return docs.table_grid(tables).select("page_id", "row", "col", "text")


@query("html_span_grid", r"""WITH tables AS (
  SELECT page_id, regexp_replace(regexp_replace(list_aggregate(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 'string_agg', chr(1)), '<[^>]*>', '', 'g'), ' +', ' ', 'g') AS body FROM pages),
rows AS (SELECT page_id, list_transform(string_split(body, chr(1)), lambda x: trim(x)) AS r FROM tables WHERE body IS NOT NULL),
places AS (SELECT page_id, r, unnest(range(0, len(r))) AS i FROM rows), cols AS (SELECT unnest(range(0, 4)) AS col)
SELECT page_id, i AS "row", col, CASE WHEN i % 2 = 0 AND col < 3 THEN r[i + 1] WHEN i % 2 = 1 AND col = 0 THEN r[i] WHEN i % 2 = 1 AND col IN (1, 3) THEN r[i + 1] ELSE '' END AS text
FROM places, cols WHERE col < CASE WHEN len(r) > 1 THEN 4 ELSE 3 END""")
def html_span_grid(t: Tables) -> DataFrame:
    """Navigation lists as tables whose cells reach down and across: of two rows the first has a cell over both and one over two
    columns, the second a cell, an empty one and a third; the last cell of an odd table would reach below it."""
    entries = F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
    even = lambda x: F.concat(F.lit("<tr><td rowspan=2>"), x, F.lit("</td><td colspan=2>"), x, F.lit("</td></tr>"))
    odd = lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td><td></td><td>"), x, F.lit("</td></tr>"))
    rows = F.array_join(F.transform(entries, lambda x, i: F.when(i % 2 == 0, even(x)).otherwise(odd(x))), "")
    tables = t.read("pages").select("page_id", F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"))
    return docs.table_grid(tables).select("page_id", "row", "col", "text")


@query("integrity_violations", f"""WITH {BLOCKS}, broken AS (
  SELECT project_id, doc_id, CASE WHEN pos % 5 = 1 THEN 'p01-b01' ELSE block_id END AS block_id, page,
    CASE WHEN kind = 'stamp' THEN 'sello' ELSE type END AS type, kind = 'code' AS inverted FROM blocks)
SELECT project_id, doc_id, block_id, 'repeated id' AS violation FROM broken GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT project_id, doc_id, block_id, 'missing page' FROM broken WHERE page > 3
UNION ALL SELECT project_id, doc_id, block_id, 'bad id' FROM broken WHERE CAST(regexp_extract(block_id, '^p(\\d+)', 1) AS INT) <> page
UNION ALL SELECT project_id, doc_id, block_id, 'unknown type' FROM broken WHERE type = 'sello'
UNION ALL SELECT project_id, doc_id, block_id, 'inverted rectangle' FROM broken WHERE inverted""".replace("\\\\d", "\\d"))
def integrity_violations(t: Tables) -> DataFrame:
    kind = F.col("pos") % 17
    flipped = F.struct(F.col("rect.x1").alias("x0"), "rect.y0", F.col("rect.x0").alias("x1"), "rect.y1")
    broken = blocks(t).withColumns({
        "block_id": F.when(F.col("pos") % 5 == 1, "p01-b01").otherwise(F.col("block_id")),
        "type": F.when(kind == 16, "sello").otherwise(F.col("type")), "rect": F.when(kind == 14, flipped).otherwise(F.col("rect"))})
    return docs.integrity_violations(broken, pages(t).filter("page <= 3"))


@query("sparse_text_pages", f"""WITH {BLOCKS}, sums AS (SELECT project_id, doc_id, page, sum(length(text)) AS chars FROM blocks GROUP BY ALL)
SELECT p.project_id, p.doc_id, p.page, coalesce(s.chars, 0)::BIGINT AS chars
FROM pages p LEFT JOIN sums s ON s.project_id = p.project_id AND s.doc_id = p.doc_id AND s.page = p.page WHERE coalesce(s.chars, 0) < 200""")
def sparse_text_pages(t: Tables) -> DataFrame:
    return docs.sparse_text_pages(blocks(t), pages(t))


@query("image_pages", f"""WITH {BLOCKS} SELECT project_id, doc_id, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages
FROM (SELECT DISTINCT project_id, doc_id, page FROM blocks WHERE is_image) GROUP BY ALL""")
def image_pages(t: Tables) -> DataFrame:
    return docs.image_pages(blocks(t)).withColumn("pages", F.array_join("pages", ","))


# a clip keeps the head of the plain text and loses its last characters to a sign that no text holds: of n characters k lost, the best
# window is the head alone, which differs by k from n, so the score is 100 (1 - k / (2 n - k))
_PLAIN = sql_norm(r"regexp_replace(text, '</?su[bp]>|\$[^$]*\$', ' ', 'g')")
_SCORE = "round_even(100.0 * (1.0 - {k} / (2.0 * n - {k})), 1)"
_RECTS = f"""cut AS (SELECT lang AS project_id, doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents),
parts AS (SELECT *, unnest(range(0, (len(ws) + 29) // 30)) AS pos FROM cut), texts AS (SELECT project_id, doc_id, pos, array_to_string(ws[pos * 30 + 1 : pos * 30 + 30], ' ') AS text FROM parts),
plain AS (SELECT *, {_PLAIN} AS p FROM texts WHERE pos % 7 <> 3), sized AS (SELECT *, length(p) AS n, length(p) // (6 + pos % 5) AS k1, length(p) // 2 AS k2 FROM plain),
checked AS (SELECT project_id, CAST(doc_id AS VARCHAR) AS doc_id, 'b' || pos AS block_id, 'parrafo' AS type, CASE WHEN n > 0 THEN {_SCORE.format(k="k1")} END AS similarity,
  CASE WHEN n = 0 THEN 'SIN_TEXTO' WHEN 100.0 * (1.0 - k1 / (2.0 * n - k1)) >= 90.0 THEN 'OK' ELSE 'REVISAR' END AS state, CASE WHEN n > 0 THEN {_SCORE.format(k="k2")} END AS control_similarity FROM sized)"""


def _checked(t: Tables) -> DataFrame:
    """Whole documents as blocks of thirty words, one in seven of them a table."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    # blocks are cut out before rows are repeated, so that no repetition carries the whole document
    cut = bind(words, lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / 30).cast("int")), lambda i: F.array_join(F.slice(ws, i * 30 + 1, F.lit(30)), " ")))
    parts = t.documents.select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(cut).alias("pos", "text"))
    b = parts.select("project_id", "doc_id", F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"), F.when(F.col("pos") % 7 == 3, "tabla").otherwise("parrafo").alias("type"), "text", "pos")
    plain, n = F.col("_plain"), F.col("_n")

    def clip(lost: Column) -> Column:
        return F.concat(F.substr(plain, F.lit(1), n - lost), F.repeat(F.lit("¬"), lost))

    read = b.filter("type <> 'tabla'").withColumn("_plain", norm(F.regexp_replace("text", r"</?su[bp]>|\$[^$]*\$", " "))).withColumn("_n", F.char_length("_plain"))
    return docs.rect_check(b, read.select("project_id", "doc_id", "block_id", clip(F.floor(n / (6 + F.col("pos") % 5)).cast("int")).alias("clip"), clip(F.floor(n / 2).cast("int")).alias("shifted")))


@query("rect_check", f"WITH {_RECTS} SELECT * FROM checked")
def rect_check(t: Tables) -> DataFrame:
    """Blocks against clips of known similarity."""
    return _checked(t)


@query("rect_check_counts", f"""WITH {_RECTS} SELECT project_id, doc_id, count(*) FILTER (state = 'OK') AS "OK", count(*) FILTER (state = 'REVISAR') AS "REVISAR",
  count(*) FILTER (state = 'SIN_TEXTO') AS "SIN_TEXTO" FROM checked GROUP BY ALL""")
def rect_check_counts(t: Tables) -> DataFrame:
    return docs.rect_check_counts(_checked(t))


# ------------------------------------------------------------------ text
@query("normalised_text", f"SELECT doc_id, sha256({sql_norm('text')}) AS norm_hash, length({sql_norm('text')}) AS chars FROM documents")
def normalised_text(t: Tables) -> DataFrame:
    n = norm("text")
    return t.documents.select("doc_id", n.alias("n")).select("doc_id", F.sha2("n", 256).alias("norm_hash"), F.char_length("n").alias("chars"))


@query("joined_text", r"""SELECT doc_id, sha256(regexp_replace(trim(replace(replace(replace(text, '.', '\_'), '-' || chr(10), ''), chr(10), ' ')), '\\([*_#])', '\1', 'g')) AS joined_hash
FROM documents""")
def joined_text(t: Tables) -> DataFrame:
    escaped = F.replace("text", F.lit("."), F.lit("\\_"))
    return t.documents.select("doc_id", F.sha2(unescape(join_lines(escaped)), 256).alias("joined_hash"))


@query("layer_requests", f"""WITH {BLOCKS} SELECT project_id, doc_id, block_id FROM blocks
WHERE type NOT IN ('tabla', 'figura') AND (trim(text) = '' OR contains(text, '$') OR contains(text, 'quality'))""")
def layer_requests(t: Tables) -> DataFrame:
    """Blocks whose text has to come from the text layer; formula marks stand where the text names quality."""
    marked = blocks(t).withColumn("text", F.replace("text", F.lit("quality"), F.lit("$q$")))
    return marked.filter(docs.needs_layer()).select("project_id", "doc_id", "block_id")


_LABELLED = f"""{BLOCKS}, counted AS (
  SELECT *, sum(CASE WHEN is_table THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, doc_id ORDER BY pos) AS table_no FROM blocks
), labelled AS (
  SELECT project_id, doc_id, pos, page, block_id, 0 AS sub, CASE
      WHEN is_table THEN '[' || block_id || ' | tabla | Tabla ' || table_no || '] leyenda: Table'
      WHEN type = 'figura' THEN '[' || block_id || ' | figura | imagen] ' || trim(replace(text, chr(10), ' ')) || ' (ver página ' || page || ' en PNG)'
      ELSE '[' || block_id || ' | ' || type || '] ' || trim(replace(text, chr(10), ' ')) END AS line
  FROM counted WHERE is_table OR type = 'figura' OR (trim(text) <> '' AND NOT contains(text, '$'))
  UNION ALL
  SELECT project_id, doc_id, pos, page, block_id, col AS sub,
    '[' || block_id || ' | tabla | Tabla ' || table_no || '] fila "' || w[1] || '" | columna "' || w[col + 1] || '" = "' || w[col + 1] || '"'
  FROM (SELECT *, string_split(line, ' ') AS w, unnest(range(1, len(string_split(line, ' ')))) AS col FROM counted WHERE is_table) WHERE w[col + 1] <> ''
)"""


@query("labelled_lines", f"WITH {_LABELLED} SELECT project_id, doc_id, pos, page, block_id, CAST(sub AS BIGINT) AS sub, line FROM labelled")
def labelled_lines(t: Tables) -> DataFrame:
    return docs.labelled_lines(shown_blocks(t))


@query("labelled_text", f"""WITH {_LABELLED} SELECT project_id, doc_id, sha256(string_agg(line, chr(10) ORDER BY pos, sub)) AS text_hash
FROM labelled GROUP BY ALL""")
def labelled_text(t: Tables) -> DataFrame:
    full = docs.labelled_text(docs.labelled_lines(shown_blocks(t)))
    return full.select("project_id", "doc_id", F.sha2("text", 256).alias("text_hash"))


@query("anchor_variants", f"WITH {BLOCKS} SELECT project_id, doc_id, block_id, CAST(0 AS BIGINT) AS variant, text_norm AS text FROM blocks WHERE text_norm <> ''")
def anchor_variants(t: Tables) -> DataFrame:
    return shown_blocks(t).select("project_id", "doc_id", "block_id", F.posexplode(docs.anchor_variants()).alias("variant", "text"))


@query("cited_blocks", f"""WITH {_LABELLED}, plain AS (SELECT * FROM labelled WHERE pos < 8), found AS (
  SELECT project_id, doc_id, block_id, string_agg(line, chr(10) ORDER BY sub) AS line FROM labelled WHERE block_id IN ('p01-b01', 'p02-b02') GROUP BY ALL)
SELECT d.lang AS project_id, CAST(d.doc_id AS VARCHAR) AS doc_id, sha256(coalesce(
  (SELECT string_agg(line, chr(10) ORDER BY block_id) FROM found f WHERE f.project_id = d.lang AND f.doc_id = CAST(d.doc_id AS VARCHAR)
   AND (f.block_id = 'p01-b01' OR d.n_chars > 1000)), '(sin bloques citados)')) AS cited_hash
FROM documents d""")
def cited_blocks(t: Tables) -> DataFrame:
    """Each document's note names its first block and, when long, one of the second page."""
    note = F.to_json(F.struct(F.array(F.lit("p01-b01"), F.when(F.col("n_chars") > 1000, "ver p02-b02 y p01-b01")).alias("ids")))
    sources = t.documents.select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("note").alias("source_id"), note.alias("json"))
    out = docs.cited_blocks(sources, docs.labelled_lines(shown_blocks(t)))
    return out.select("project_id", "doc_id", F.sha2("cited", 256).alias("cited_hash"))


@query("quote_fragments", f"""WITH {BLOCKS}, frag AS (
  SELECT project_id, doc_id, page, pos, text_norm AS t, sum(length(text_norm) + 1) OVER (PARTITION BY project_id, doc_id, page ORDER BY pos) - 1 AS e
  FROM blocks WHERE text_norm <> ''
), whole AS (SELECT project_id, doc_id, page, string_agg(t, ' ' ORDER BY pos) AS body, arg_min(t, pos) AS head FROM frag GROUP BY ALL),
quotes AS (SELECT *, trim(right(head, 12) || substr(body, length(head) + 1, 12)) AS q FROM whole),
spans AS (SELECT *, strpos(body, q) - 1 AS a, strpos(body, q) - 1 + length(q) AS b FROM quotes WHERE contains(body, q))
SELECT f.project_id, f.doc_id, f.page, f.pos FROM frag f JOIN spans s ON s.project_id = f.project_id AND s.doc_id = f.doc_id AND s.page = f.page
WHERE f.e > s.a AND f.e - length(f.t) < s.b""")
def quote_fragments(t: Tables) -> DataFrame:
    """A quote over the border of the first two fragments of every page."""
    b = blocks(t)
    fragments = b.select("project_id", "doc_id", "page", "pos", "text")
    texts = b.filter("text_norm <> ''").groupBy("project_id", "doc_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text_norm"))), lambda x: x["text_norm"]), " ").alias("body"),
        F.min_by("text_norm", "pos").alias("head"))
    quote = F.trim(F.concat(F.right("head", F.lit(12)), F.substr("body", F.char_length("head") + 1, F.lit(12))))
    quotes = texts.select("project_id", "doc_id", "page", F.lit(1).alias("quote_id"), quote.alias("quote"))
    return docs.quote_fragments(fragments, quotes).select("project_id", "doc_id", "page", "pos")


@query("numbers_in_text", r"""WITH found AS (SELECT event_id, regexp_extract_all(props || ' -' || replace(CAST(value AS VARCHAR), '.', ','), '-?\d*[.,]\d+|-?\d+') AS n FROM events)
SELECT event_id, CAST(len(n) AS BIGINT) AS numbers, round(list_sum(list_transform(n, lambda x: abs(CAST(replace(x, ',', '.') AS DOUBLE)))), 6) AS total FROM found""")
def numbers_in_text(t: Tables) -> DataFrame:
    text = F.concat("props", F.lit(" -"), F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
    e = t.read("events").select("event_id", numbers_in(text).alias("n"))
    return e.select("event_id", F.size("n").alias("numbers"), F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("response_json", """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 AND length(text) % 2 = 0 THEN NULL
  ELSE sha256(text) END AS text_hash, CASE WHEN turn % 3 = 2 AND length(text) % 2 = 0 THEN NULL ELSE 1 END::BIGINT AS objects FROM conversations""")
def response_json_query(t: Tables) -> DataFrame:
    """Messages wrapped as responses: fenced, followed by text, bare, or cut."""
    obj = F.to_json(F.struct("text"))
    way = F.col("turn") % 3
    body = (
        F.when(way == 0, F.concat(F.lit("Respuesta:\n```json\n"), obj, F.lit("\n```\nlisto")))
        .when(way == 1, F.concat(F.lit("Aquí va: ["), obj, F.lit("] y nada más")))
        .when(F.char_length("text") % 2 == 0, F.concat(F.lit("{\"text\": "), F.lit("sin fin")))
        .otherwise(obj))
    items_ = t.read("conversations").select("conv_id", "turn", response_objects(body).alias("o"))
    return items_.select("conv_id", "turn", F.sha2(F.get_json_object(F.get("o", F.lit(0)), "$.text"), 256).alias("text_hash"),
                         F.when(F.col("o").isNotNull(), F.size("o")).alias("objects"))


# ------------------------------------------------------------------ anchors
@query("anchor_literal", f"""WITH {EVIDENCE} SELECT project_id, doc_id, row_pos, level, CASE WHEN level IS NOT NULL THEN block_id END AS block_id,
  CASE WHEN level IS NOT NULL THEN start END AS start, CASE WHEN level IS NOT NULL THEN start + length(q) END AS "end" FROM literal""")
def anchor_literal(t: Tables) -> DataFrame:
    b = stored_blocks(t)
    a = anchoring.anchor_literal(evidence(t, b), b)
    found = F.col("level").isNotNull()
    return a.select("project_id", "doc_id", "row_pos", "level", F.when(found, F.col("block_id")).alias("block_id"),
                    F.when(found, F.col("range.start")).alias("start"), F.when(found, F.col("range.end")).alias("end"))


@query("corrected_citations", f"""WITH {EVIDENCE} SELECT project_id, doc_id, row_pos, 'la cita está en ' || block_id || ', no en ' || cited AS note
FROM literal WHERE level = 'VERIFICADA_CON_CORRECCION'""")
def corrected_citations(t: Tables) -> DataFrame:
    b = stored_blocks(t)
    return anchoring.anchor_literal(evidence(t, b), b).filter("level = 'VERIFICADA_CON_CORRECCION'").select("project_id", "doc_id", "row_pos", "note")


@query("anchor_all_levels")
def anchor_all_levels(t: Tables) -> DataFrame:
    """The whole cascade, approximate steps included."""
    b = stored_blocks(t)
    a = anchoring.anchor(evidence(t, b), b)
    return a.select("project_id", "doc_id", "row_pos", "level", "similarity", "block_id", "page", "note")


@query("anchor_table_cells", f"""WITH {BLOCKS}, words AS (SELECT project_id, doc_id, block_id, pos, string_split(line, ' ') AS w, text_norm FROM blocks WHERE is_table),
quotes AS (SELECT *, {sql_norm('w[2]')} AS q FROM words)
SELECT project_id, doc_id, pos AS row_pos, CASE WHEN q IS NULL OR q = '' THEN 'sin cita' ELSE 'celda de tabla' END AS note FROM quotes""")
def anchor_table_cells(t: Tables) -> DataFrame:
    """Quotes of the first body cell of each table, named by its labels."""
    b = stored_blocks(t)
    first = F.split("line", " ")
    lines = b.filter("is_table").withColumn("line", F.get(F.split("text", "\n"), F.lit(1)))
    ev = lines.select(
        "project_id", F.col("doc_id").alias("extraction_id"), "doc_id", F.col("pos").alias("row_pos"), F.lit(1).cast("bigint").alias("study"),
        F.lit("Muestra").alias("column"), F.lit(0).alias("ev_idx"), F.col("page").alias("page_hint"), F.get(first, F.lit(1)).alias("quote"),
        F.get(first, F.lit(0)).alias("table_row"), F.get(first, F.lit(1)).alias("table_col"), F.lit(False).alias("figure"), "block_id")
    a = anchoring.anchor_literal(ev, b)
    return a.select("project_id", "doc_id", "row_pos", F.when(F.col("note") == "", "sin cita").otherwise(F.col("note")).alias("note"))


@query("fuzzy_near_page")
def fuzzy_near_page(t: Tables) -> DataFrame:
    """Best approximate place of every quote that stands nowhere in its document as written."""
    b = stored_blocks(t).withColumn("variants", docs.anchor_variants())
    quotes = evidence(t, b).select("project_id", "doc_id", norm("quote").alias("q"), F.col("page_hint").alias("near_page")).filter("q <> ''")
    found = anchoring.first_in_document(quotes.select("project_id", "doc_id", "q"), b)
    best = anchoring.best_near_page(quotes.join(found, ["project_id", "doc_id", "q"], "left_anti"), b)
    return best.select("project_id", "doc_id", "q", "near_page", "best.block_id", F.round("best.score", 4).alias("score"))


_LITERAL_COUNTS = f"""WITH {EVIDENCE}, levels AS (SELECT unnest(['VERIFICADA', 'VERIFICADA_CON_CORRECCION', 'POR_CONFIRMAR', 'NO_VERIFICABLE']) AS level)
SELECT l.level, count(x.doc_id) AS n FROM levels l LEFT JOIN literal x ON x.level = l.level GROUP BY ALL"""


@query("level_totals", _LITERAL_COUNTS)
def level_totals(t: Tables) -> DataFrame:
    b = stored_blocks(t)
    return anchoring.level_totals(anchoring.anchor_literal(evidence(t, b), b))


@query("level_summary", f"""WITH {EVIDENCE} SELECT project_id, doc_id, count(*) FILTER (level = 'VERIFICADA') AS "VERIFICADA",
  count(*) FILTER (level = 'VERIFICADA_CON_CORRECCION') AS "VERIFICADA_CON_CORRECCION", 0::BIGINT AS "POR_CONFIRMAR", 0::BIGINT AS "NO_VERIFICABLE"
FROM literal GROUP BY ALL""")
def level_summary(t: Tables) -> DataFrame:
    b = stored_blocks(t)
    return anchoring.level_summary(anchoring.anchor_literal(evidence(t, b), b), ["project_id", "doc_id"])


@query("worst_level", f"""WITH {EVIDENCE}, ranked AS (SELECT project_id, doc_id, row_pos // 4 AS cell,
  max(CASE level WHEN 'VERIFICADA' THEN 1 WHEN 'VERIFICADA_CON_CORRECCION' THEN 2 ELSE 4 END) AS r FROM literal GROUP BY ALL)
SELECT project_id, doc_id, cell, CASE r WHEN 1 THEN 'VERIFICADA' WHEN 2 THEN 'VERIFICADA_CON_CORRECCION' ELSE 'NO_VERIFICABLE' END AS level,
  CASE WHEN r <= 2 THEN 'PENDIENTE' ELSE 'NO_VERIFICABLE' END AS review_state FROM ranked""")
def worst_level(t: Tables) -> DataFrame:
    """Cells of four evidences each; what no exact step finds counts as not verifiable here."""
    b = stored_blocks(t)
    a = anchoring.anchor_literal(evidence(t, b), b).withColumn("level", F.coalesce("level", F.lit("NO_VERIFICABLE")))
    return anchoring.worst_level(a.withColumn("cell", F.floor(F.col("row_pos") / 4)), ["project_id", "doc_id", "cell"])


@query("attached_anchors", f"""WITH {EVIDENCE} SELECT project_id, doc_id, row_pos, CASE WHEN row_pos = max(row_pos) OVER (PARTITION BY project_id, doc_id) THEN level END AS level FROM literal""")
def attached_anchors(t: Tables) -> DataFrame:
    """All rows of a document share their study, so only the last row takes anchors."""
    b = stored_blocks(t)
    ev = evidence(t, b)
    out = anchoring.attach_anchors(ev, anchoring.anchor_literal(ev, b))
    return out.select("project_id", "doc_id", "row_pos", F.col("anchor.level").alias("level"))


@query("verified_rate", f"""WITH {EVIDENCE}, c AS (SELECT project_id, doc_id, count(*) AS quotes, count(*) FILTER (level IS NOT NULL) AS verified FROM literal WHERE NOT figure GROUP BY ALL)
SELECT project_id, doc_id, quotes, verified, round(verified / quotes, 6) AS rate, verified / quotes >= 0.95 AS accepted FROM c""")
def verified_rate(t: Tables) -> DataFrame:
    b = stored_blocks(t)
    out = anchoring.verified_rate(anchoring.anchor_literal(evidence(t, b), b), ["project_id", "doc_id"])
    return out.withColumn("rate", F.round("rate", 6))


@query("passage_locations", f"""WITH b AS (SELECT item_id, {sql_norm('text')} AS q FROM benchmark), d AS (SELECT doc_id, {sql_norm('text')} AS t FROM documents)
SELECT item_id AS quote_id, doc_id, strpos(t, q) - 1 AS start FROM b JOIN d ON contains(t, q)""")
def passage_locations(t: Tables) -> DataFrame:
    quotes = t.read("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return passages.passage_locations(quotes, t.documents.select("doc_id", "text"))


@query("anchor_keys", f"""WITH {EVIDENCE} SELECT project_id, doc_id, row_pos || '|Muestra|0' AS key, cited AS block_id FROM evidence""")
def anchor_keys(t: Tables) -> DataFrame:
    """Keys of named blocks, taken out of the evidence and merged back."""
    b = stored_blocks(t)
    ev = evidence(t, b)
    merged = anchoring.merge_anchor_keys(ev.withColumn("block_id", F.lit(None).cast("string")), anchoring.anchor_keys(ev))
    return anchoring.anchor_keys(merged).select("project_id", F.col("extraction_id").alias("doc_id"), "key", "block_id")


@query("long_quotes", f"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, len(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ')) AS words
FROM (SELECT doc_id, parts[i + 1] AS line, i AS pos FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
WHERE trim(line) <> '' AND len(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ')) > 25""")
def long_quotes(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("words", word_count("line")).filter("words > 25").select("doc_id", "pos", "words")
