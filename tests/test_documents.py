import pytest
from pyspark.sql import functions as F

from quoteloom.functions.grid import html_grid
from quoteloom.functions.text import norm
from quoteloom.operators import anchoring, documents as docs, rules
from quoteloom.schemas import BLOCKS
from quoteloom.sources.converter import converter_items, converter_pages, rejected_outputs

RECT = (36.0, 44.5, 210.25, 97.0)
EV = ("project_id string, extraction_id string, doc_id string, row_pos int, study long, column string, ev_idx int, page_hint int, quote string, "
      "table_row string, table_col string, figure boolean, block_id string")


@pytest.fixture(scope="module")
def blocks(spark):
    # a survey of river gauges: two pages of prose, a table, a drawing, a formula whose characters came apart
    rows = [
        ("p01-b01", "parrafo", "Forty-one gauges along the Ebro were read every morning from March to June.", None, None, False),
        ("p01-b02", "tabla", "Table 4 Mean level by bank\nleft 2.08 m\nSource: own readings", [["left", "2.08 m"]], [(1, 1, "2.08 m", "left", "level")], False),
        ("p02-b01", "parrafo", "Two of them had been moved after the flood of the previous winter.", None, None, False),
        ("p03-b01", "parrafo", "Upstream gauges rose several hours before those near the delta did.", None, None, False),
        ("p03-b02", "parrafo", "slope $( \\mathsf { k } { = } 1 . 7 )$ of the rating curve", None, None, False),
        ("p03-b03", "figura", "", None, None, True),
        ("p03-b04", "parrafo", "", None, None, False),
    ]
    data = [("P", "D", i, int(r[0][1:3]), i, r[0], r[1], RECT, r[2], None, r[1] == "tabla", r[5], r[3], r[4], None) for i, r in enumerate(rows)]
    b = spark.createDataFrame(data, BLOCKS).withColumn("text_norm", norm("text"))
    layer = spark.createDataFrame([("P", "D", "p03-b04", "the last reading was lost"), ("P", "D", "p03-b02", "slope (k = 1.7) of the rating curve")],
                                  "project_id string, doc_id string, block_id string, layer_text string")
    return docs.effective_blocks(b, layer)


CASES = [  # quote, cited block, page, labels, figure → level, block
    ("gauges along the Ebro", "p01-b01", 1, (None, None), False, "VERIFICADA", "p01-b01"),
    ("2.08 m", "p01-b02", 1, ("left", "level"), False, "VERIFICADA", "p01-b02"),
    ("moved after the flood", "p01-b01", 1, (None, None), False, "VERIFICADA_CON_CORRECCION", "p02-b01"),
    ("several hours before", "p77-b02", 3, (None, None), False, "VERIFICADA_CON_CORRECCION", "p03-b01"),
    ("Upstream gauges rose sevral hours before those near", "p03-b01", 3, (None, None), False, "POR_CONFIRMAR", "p03-b01"),
    ("6.4", "p03-b03", 3, (None, None), True, "POR_CONFIRMAR", "p03-b03"),
    ("nothing like it was ever written down here", "p01-b01", 1, (None, None), False, "NO_VERIFICABLE", "p01-b01"),
    ("reading was lost", "p03-b04", 3, (None, None), False, "VERIFICADA", "p03-b04"),
    ("(k = 1.7)", "p03-b02", 3, (None, None), False, "VERIFICADA", "p03-b02"),
    ("", "p01-b01", 1, (None, None), False, "NO_VERIFICABLE", "p01-b01"),
    ("one gau", None, 1, (None, None), False, "VERIFICADA_CON_CORRECCION", "p01-b01"),
    ("y", None, 1, (None, None), False, "VERIFICADA_CON_CORRECCION", "p01-b01"),
]


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame([("P", "E", "D", 0, 7, "c", i, c[2], c[0], *c[3], c[4], c[1]) for i, c in enumerate(CASES)], EV)


def test_cascade(blocks, evidence):
    got = {r.ev_idx: r for r in anchoring.anchor(evidence, blocks, 90.0).collect()}
    assert [(got[i].level, got[i].block_id) for i in range(len(CASES))] == [(c[5], c[6]) for c in CASES]
    assert got[0].range.start == 10 and got[0].range.end == 31 and tuple(got[0].rect) == RECT
    assert got[1].note == "celda de tabla" and got[1].range is None
    assert got[2].note == "la cita está en p02-b01, no en p01-b01"
    assert got[4].similarity >= 90 and got[9].similarity == 0.0


def test_literal_search_equals_brute_force(spark):
    texts = ["seven red boats left port", "a redoubt by the airport", "port", "left port seven red", "q"]
    quotes = ["red", "left port", "or", "e", "red boats left", "ven red boats left p", "ww", "left port seven red", "a r"]
    units = spark.createDataFrame([("P", i, [t]) for i, t in enumerate(texts)], "p string, u int, variants array<string>")
    asked = spark.createDataFrame([("P", q) for q in quotes], "p string, q string")
    got = {(r.q, r.u, r.start) for r in anchoring.locate_literal(asked, units, ["p"], ["u"]).collect()}
    assert got == {(q, i, t.find(q)) for q in quotes for i, t in enumerate(texts) if q in t}


def test_no_cartesian_product_in_the_literal_search(spark, blocks):
    quotes = spark.createDataFrame([("P", "D", "a b c")], "project_id string, doc_id string, q string")
    plan = anchoring.first_in_document(quotes, blocks.withColumn("variants", docs.anchor_variants()))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan


def test_quote_over_a_block_border_is_literal_in_the_article(spark, blocks):
    ev = spark.createDataFrame([("P", "E", "D", 0, 7, "c", i, 3, q, None, None, fig, None) for i, (q, fig) in enumerate(
        [("previous winter. Upstream gauges", False), ("winter Upstream", False), ("winter Upstream", True)])], EV)
    got = rules.v23_not_literal(ev, blocks).collect()
    assert [r.message for r in got] == ["Cita de 'c' no se encuentra literal en el PDF: winter Upstream"]


def test_labelled_text(blocks):
    lines = docs.labelled_text(docs.labelled_lines(blocks)).first().text.split("\n")
    assert lines[0] == "[p01-b01 | parrafo] Forty-one gauges along the Ebro were read every morning from March to June."
    assert lines[1:4] == ["[p01-b02 | tabla | Tabla 1] leyenda: Table 4 Mean level by bank", '[p01-b02 | tabla | Tabla 1] fila "left" | columna "level" = "2.08 m"',
                          "[p01-b02 | tabla | Tabla 1] nota: Source: own readings"]
    assert "[p03-b03 | figura | imagen] (sin texto) (ver página 3 en PNG)" in lines


def spanned(width, height, spans):
    """A table whose cells are numbered, with the given (row, column, down, across) spans, and the grid it means."""
    grid, rows, taken = [[""] * width for _ in range(height)], [], set()
    for r in range(height):
        cells = []
        for c in range(width):
            if (r, c) not in taken:
                down, across = next(((d, a) for y, x, d, a in spans if (y, x) == (r, c)), (1, 1))
                places = {(r + i, c + j) for i in range(down) for j in range(across)}
                taken |= places
                for y, x in places:
                    grid[y][x] = f"n{r}{c}"
                cells.append(f"<td rowspan={down} colspan='{across}'> n{r}{c} </td>")
        rows.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "\n".join(rows) + "</table>", grid


def test_grid_spans():
    for spans in ([], [(0, 0, 2, 1)], [(0, 1, 1, 3), (1, 2, 2, 2)], [(1, 0, 3, 2), (0, 3, 4, 1)]):
        html, grid = spanned(4, 4, spans)
        assert html_grid(html) == grid
    assert html_grid("<table><tr><td colspan='2px'>u<td rowspan='x'>v</tr></table>") == [["u", "u", "v"]]
    assert html_grid("<tr><td colspan=1000000000 rowspan=1000000000>u</td></tr>") == [["u"] * 1000]


def test_converter_output(spark):
    content = ('[{"page_idx":0,"type":"text","text_level":1,"bbox":[100,100,500,200],"text":"Título"},{"page_idx":0,"type":"text","text":"sin caja"},'
               '{"page_idx":0,"type":"table","bbox":[0,0,1000,1000],"table_caption":["T1"],"table_body":"<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"},'
               '{"page_idx":4,"type":"text","bbox":[0,0,1,1],"text":"página desconocida"},{"page_idx":0,"type":"table","bbox":[0,0,1,1],"table_body":"<img>"}]')
    raw = spark.createDataFrame([("P", "D", content, '{"pdf_info":[{"page_idx":0,"page_size":[600,800]}]}'), ("P", "X", "[]", None)],
                                "project_id string, doc_id string, content_list string, middle string")
    b = docs.blocks_from_items(converter_items(raw), converter_pages(raw)).orderBy("pos").collect()
    assert [(r.block_id, r.type, r.text, r.is_image) for r in b] == [
        ("p01-b01", "titulo", "Título", False), ("p01-b02", "tabla", "T1\na b\nc d", False), ("p01-b03", "tabla", "", True)]
    assert tuple(b[0].rect) == (60.0, 80.0, 300.0, 160.0) and [tuple(c) for c in b[1].cells] == [(1, 1, "d", "c", "b")]
    assert [r.doc_id for r in rejected_outputs(raw).collect()] == ["X"]


def test_quote_fragments_with_a_word_break(spark):
    fragments = spark.createDataFrame([("P", "D", 1, i, t) for i, t in enumerate(["river lev-", "els near", "", "Tortosa"])], "project_id string, doc_id string, page int, pos int, text string")
    quotes = spark.createDataFrame([("P", "D", 1, 1, "levels near"), ("P", "D", 1, 2, "near Tortosa"), ("P", "D", 1, 3, "no")],
                                   "project_id string, doc_id string, page int, quote_id int, quote string")
    got = sorted((r.quote_id, r.pos) for r in docs.quote_fragments(fragments, quotes).collect())
    assert got == [(1, 0), (1, 1), (2, 1), (2, 3)]


def test_rect_check_states(spark, blocks):
    clips = blocks.select("project_id", "doc_id", "block_id", F.col("text").alias("clip"), F.lit("zzz").alias("shifted"))
    got = {r.block_id: (r.state, r.similarity) for r in docs.rect_check(blocks, clips).collect()}
    assert got["p01-b01"] == ("OK", 100.0) and got["p03-b04"] == ("SIN_TEXTO", None) and "p03-b03" not in got
