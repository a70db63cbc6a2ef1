"""Jobs with sequential meaning against a plain sequential pass."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quoteloom.functions.typed import cell_text, cells_equal, int_cell, variant_cell
from quoteloom.operators import compare, export, library, matrix, reconcile, review, rules
from quoteloom.operators.ordering import carry_last, running_sum
from quoteloom.schemas import EVIDENCE, TRACE
from quoteloom.sources.coded import coded_rows
from quoteloom.sources import files
from quoteloom.sources.sheets import typed_text
from quoteloom.sources.sinks import write_files
from quoteloom.streaming import events, stateful
from quoteloom.streaming.run import ROCKSDB, drain, in_micro_batches
from quoteloom.session import shared_folder

CELL = "struct<kind:string,num:double,str:string>"


def test_running_sum_and_carry(spark):
    rng = random.Random(5)
    rows = [(k, p, rng.choice([None, 1, 2, 3])) for k in "ab" for p in rng.sample(range(5000), 60)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    sums = {(r.k, r.p): r.s for r in running_sum(df, ["k"], "p", F.coalesce("v", F.lit(0)), "s", 64).collect()}
    last = {(r.k, r.p): r.c for r in carry_last(df, ["k"], "p", F.col("v"), "c", 64).collect()}
    for k in "ab":
        total, seen = 0, None
        for _, p, v in sorted(r for r in rows if r[0] == k):
            total += v or 0
            assert sums[k, p] == total and last[k, p] == seen
            seen = v if v is not None else seen


def test_typed_equality(spark):
    pairs = [("1", "1.0005", True), ("1", "1.002", False), ("true", "1", False), ("true", "true", True), ('" a "', '"a"', True), ('"1"', "1", False), ("null", "null", True),
             ("null", '"x"', False), ("[1]", "[1]", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.withColumns({"a": variant_cell(F.parse_json("a")), "b": variant_cell(F.parse_json("b"))}).withColumn("got", cells_equal(F.col("a"), F.col("b"))).collect()
    assert [r.got for r in got] == [p[2] for p in pairs]


def _sequential(actions, opened):
    state, value, refused, history = opened, "v0", {}, []
    for a in actions:
        bare = not (a["reason"] or "").strip()
        if a["action"] == "CORREGIR" and bare or a["action"] == "RECHAZAR" and bare or a["author"] == "":
            refused[a["seq"]] = True
        elif a["action"] == "CORREGIR" and a["value"] not in ("x", "y"):
            refused[a["seq"]] = True
        elif a["action"] == "APROBAR" and bare and state in ("NO_VERIFICABLE", "POR_CONFIRMAR", "SIN_EVIDENCIA"):
            refused[a["seq"]] = True
        else:
            new = a["value"] if a["action"] == "CORREGIR" else value
            history.append((a["seq"], value, new))
            state, value = {"APROBAR": "APROBADA", "CORREGIR": "CORREGIDA", "RECHAZAR": "RECHAZADA"}[a["action"]], new
    return state, value, set(refused), history


def test_review_equals_a_sequential_fold_in_batch_and_stream(spark):
    rng = random.Random(9)
    opened = {s: rng.choice(["PENDIENTE", "NO_VERIFICABLE", "SIN_EVIDENCIA", "POR_CONFIRMAR"]) for s in range(40)}
    log, seq = [], 0
    for _ in range(400):
        seq += 1
        log.append({"study": rng.randrange(40), "seq": seq, "action": rng.choice(["APROBAR", "APROBAR", "CORREGIR", "RECHAZAR"]), "reason": rng.choice([None, " ", "r"]),
                    "author": rng.choice(["ana", "ana", "ana", ""]), "value": rng.choice(["x", "y", "mala"])})
    actions = spark.createDataFrame([("P", a["study"], "k", a["seq"], a["author"], a["action"], ("str", None, a["value"]), None, a["reason"]) for a in log],
                                    f"project_id string, study long, key string, seq long, author string, action string, new_value {CELL}, new_data_state string, reason string")
    cells = spark.createDataFrame([("P", s, "k", ("str", None, "v0"), None, o) for s, o in opened.items()],
                                  f"project_id string, study long, key string, value {CELL}, data_state string, review_state string")
    columns = spark.createDataFrame([("P", "k", ["x", "y"], "texto", True, 1)], "project_id string, key string, allowed array<string>, data_type string, is_numeric boolean, position int")
    judged = review.judged_actions(actions, cells, columns)
    states = {r.study: (r.review_state, r.value.str) for r in review.reviewed_cells(cells, judged).collect()}
    refused = {r.seq for r in review.refused(judged).collect()}
    changes = {r.seq: (r.old_value.str, r.new_value.str) for r in review.history(cells, judged).collect()}
    timed = actions.withColumn("at", F.timestamp_seconds("seq"))
    streamed = drain(stateful.review_stream(in_micro_batches(timed, "at", 4, 50), cells, columns, "50 seconds")).collect()
    for s, o in opened.items():
        state, value, bad, history = _sequential([a for a in log if a["study"] == s], o)
        assert states[s] == (state, value)
        assert bad == {a["seq"] for a in log if a["study"] == s} & refused == {r.seq for r in streamed if r.study == s and r.refusal}
        last = max((r for r in streamed if r.study == s), key=lambda r: r.seq, default=None)
        assert last is None or (last.review_state, json.loads(last.value_json)) == (state, value)
        assert {q: (a, b) for q, a, b in history} == {q: c for q, c in changes.items() if q in {h[0] for h in history}}


def test_slots_equal_a_sequential_pass(spark):
    rng = random.Random(2)
    rows = [(p, s, rng.choice([None, s + 2, rng.randrange(2, 30)])) for p in ("A", "B") for s in range(1, 25)] + [("C", s, s + 1) for s in range(1, 20)]
    got = {(r.project_id, r.study): r.sheet_row for r in export.place_inherited(spark.createDataFrame(rows, "project_id string, study long, origin_row int")).collect()}
    for p in "ABC":
        used: list[int] = []
        for _, study, origin in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            used.append(origin if origin and origin not in used else min(set(range(2, 100)) - set(used)))
            assert got[p, study] == used[-1]


def test_lifecycle_stream_equals_batch(spark):
    moves = spark.createDataFrame(
        [("P", "a", i, s, r, st) for i, (s, r, st) in enumerate([("NUEVO", None, None), ("CONVIRTIENDO", None, None), ("ERROR", "x", "CONVIRTIENDO"), ("CONVIRTIENDO", None, None), ("EN_COLA", None, None)])]
        + [("P", "b", i, s, r, None) for i, (s, r) in enumerate([("LISTO", None), ("EXCLUIDO", " "), ("NUEVO", None), ("EXCLUIDO", "dup")])],
        "project_id string, article_id string, seq long, new_state string, reason string, step string")
    batch = {(r.article_id, r.seq, r.problem) for r in library.illegal_moves(moves).collect()}
    assert batch == {("a", 4, "Transición inválida: CONVIRTIENDO → EN_COLA"), ("b", 0, "Transición inválida: - → LISTO"), ("b", 1, "Excluir exige motivo")}
    timed = moves.withColumn("at", F.timestamp_seconds(10 * F.col("seq") + 10))
    out = drain(stateful.lifecycle_stream(in_micro_batches(timed, "at", 3, 40), "40 seconds"))
    assert out.count() == moves.count() and {(r.article_id, r.seq, r.problem) for r in out.filter("problem is not null").collect()} == batch


def test_lifecycle_state_waits_and_ends(spark):
    """Changes that come in the wrong order over micro-batches, and what is left in the state store once time has passed."""
    folder = shared_folder(spark)
    ddl = "project_id string, article_id string, seq long, new_state string, reason string, step string, at timestamp"
    day = 24 * 3600
    batches = [[("b", 1, "CONVIRTIENDO", 20), ("a", 1, "CONVIRTIENDO", 30)], [("b", 0, "NUEVO", 10), ("a", 0, "NUEVO", 5)], [("c", 0, "NUEVO", 2 * day)], [("~", 0, "NUEVO", 80 * day)], [("~", 1, "NUEVO", 81 * day)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([("P", a, s, n, None, None, t) for a, s, n, t in rows], ddl.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/m")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/m")
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, ROCKSDB)
    query = stateful.lifecycle_stream(stream, "1 minute").writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    out = {(r.article_id, r.seq): (r.prev_state, r.problem) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert out[("a", 1)] == out[("b", 1)] == ("NUEVO", None) and out[("a", 0)] == out[("b", 0)] == out[("c", 0)] == (None, None)
    held = lambda name: {r.article_id for r in spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", name).load().select("key.article_id").collect()}
    assert held("state") <= {"~"} and held("waiting") <= {"~"} and held("clock") <= {"~"}
    spark.conf.unset(setting)


class Stopped(BaseException):
    """The end of a process, which no handler error is."""


def test_outbox_batch_that_was_stopped_halfway(spark):
    """One handler did its work before the stop and is not called again; the other is called again and replaces what it left."""
    folder = shared_folder(spark)
    rows = spark.createDataFrame([(1, "P", "A", "1"), (2, "P", "B", "2"), (3, "Q", "B", "3"), (4, "Q", "other", "4")], "id long, project_id string, name string, data string")
    calls = []

    def counted(df, delivery):
        calls.append(delivery)
        return df.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    cells = events.cells_handler(lambda e: e.select("id", "project_id", F.lit(1).alias("study"), F.col("data").alias("value")), ["project_id", "study"], f"{folder}/cells")

    def stopped(df, delivery):
        cells(df, delivery)
        raise Stopped  # after the write, before the ledger knows of it

    with pytest.raises(Stopped):
        events.delivered_apart(rows, {"A": counted, "B": stopped}, f"{folder}/ledger", "0-0")
    found = events.delivered_apart(rows, {"A": counted, "B": cells}, f"{folder}/ledger", "0-0")
    assert calls == ["0-0-A"] and sorted((r.id, r.ok) for r in found.collect()) == [(1, True), (2, True), (3, True), (4, True)]
    assert sorted((r.project_id, r.value) for r in events.written(spark, f"{folder}/cells", ["project_id", "study"]).collect()) == [("P", "2"), ("Q", "3")]


def test_folder_stream_goes_on_after_a_restart(spark):
    folder = shared_folder(spark)
    put = lambda names: write_files(spark.createDataFrame([(f"P/{n}.pdf", c) for n, c in names], "path string, content string"), f"{folder}/in")
    load = lambda: files.load_stream(files.stream_folder(spark, f"{folder}/in", at_once=2), f"{folder}/ledger", f"{folder}/state").awaitTermination()
    assert put([("1. a", "%PDF x"), ("2. b", "%PDF y"), ("c", "no pdf")]) == 3
    load()
    put([("3. d", "%PDF x"), ("4. e", "%PDF z"), ("5. f", "%PDF z")])
    load()
    load()
    got = {r.file_name: (r.outcome, r.duplicate_of, r.document) for r in files.ledger_outcomes(spark, f"{folder}/ledger").collect()}
    assert got["1. a.pdf"] == ("loaded", None, 1) and got["c.pdf"][0] == "error" and got["3. d.pdf"] == ("duplicate", "1. a.pdf", 3)
    assert len(got) == 6 and sorted(got[f"{n}.pdf"][0] for n in ("4. e", "5. f")) == ["duplicate", "loaded"]


def test_idle_state_is_removed(spark):
    folder = shared_folder(spark)
    batches = [[("a", 0, False), ("b", 10, False)], [("b", 100, True)], [("z", 4 * 3600, False)], [("z", 5 * 3600, True)], [("z", 9 * 3600, True)]]
    for rows in batches:
        df = spark.createDataFrame([("P", e, t + 1000, f) for e, t, f in rows], "project_id string, extraction_id string, ts long, finished boolean").withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/p")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p")
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, ROCKSDB)
    query = stateful.idle_stream(stream).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    assert {r.extraction_id for r in spark.read.parquet(f"{folder}/out").collect()} == {"a"}
    left = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "seen").load().select("key.extraction_id").collect()
    assert {r.extraction_id for r in left} <= {"z"}
    spark.conf.unset(setting)


def test_coded_rows_and_double_coding(spark):
    a = '[{"fila": {"Estudio": 1, "Muestra": 395, "Nivel": "Individual"}, "trazabilidad": {"tipo_de_efecto": "simple", "evidencia": {"Muestra": [{"pagina_pdf": 3, "cita_textual": "n = 395", "bloque_id": "p03-b01"}]}}}, {"fila": {"Estudio": 2}}]'
    b = '```json\n{"fila": {"Estudio": 1, "Muestra": 395.0004, "Nivel": " Individual "}, "trazabilidad": {"tipo_de_efecto": "parcial"}}\n```'
    ddl = "project_id string, extraction_id string, doc_id string, content string"
    ca, cb = coded_rows(spark.createDataFrame([("P", "E", "D", a)], ddl)), coded_rows(spark.createDataFrame([("P", "E", "D", b)], ddl), tolerant=True)
    diffs = compare.compare_codings(ca, cb).filter("not equal").collect()
    assert {(r.row_pos, r.field, r.a, r.b) for r in diffs} == {(None, "número de filas", "2", "1"), (0, "tipo_de_efecto", '"simple"', '"parcial"')}
    assert compare.agreement(compare.compare_codings(ca, cb)).first() == compare.agreement_of(ca, cb).first()
    assert compare.agreement_of(ca, cb).first().agreement == round(20 / 22, 3)


def test_vocabulary(spark):
    cases = [(None, "texto", True), ("a", "texto", True), ("b; a", "categoría múltiple", True), ("b; a", "texto", False), ("Otro: z", "texto", True), ("Otro: ", "texto", False)]
    df = spark.createDataFrame([((("null" if v is None else "str"), None, v), t, ["a", "b", "Otro: (x)"]) for v, t, _ in cases], f"c {CELL}, t string, allowed array<string>")
    assert [r.ok for r in df.select(rules.vocabulary_ok(F.col("c"), F.col("allowed"), F.col("t")).alias("ok")).collect()] == [c[2] for c in cases]


def test_upsert_keeps_the_last_of_a_batch(spark):
    old = spark.createDataFrame([("P", 1, "old"), ("P", 2, "old")], "project_id string, study int, v string")
    new = spark.createDataFrame([("P", 2, "n1", 1), ("P", 2, "n2", 2), ("P", 3, "n3", 3)], "project_id string, study int, v string, o int")
    assert {(r.study, r.v) for r in matrix.upsert(old, new, ["project_id", "study"], "o").collect()} == {(1, "old"), (2, "n2"), (3, "n3")}


def _coded(spark, rows):
    """Rows of (study as JSON, sample, country) with document 7 or 7.0."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_pos int, study string, document string, sample string, country string")
    cell = lambda c: variant_cell(F.parse_json(c)).cast(CELL)
    fila = F.create_map(F.lit("Estudio"), cell("study"), F.lit("Documento"), cell("document"), F.lit("Pais"), cell("country"))
    return df.select(F.lit("P").alias("project_id"), F.lit("E").alias("extraction_id"), F.lit("D").alias("doc_id"), "row_pos", fila.alias("fila"), F.struct(F.col("sample").alias("id_muestra")).alias("traz"))


def test_group_rules_compare_values(spark):
    rows = _coded(spark, [("1", "7", "s", "3"), ("1.0", "7.0", "s", "3.0"), ("12345678901234567", "8", "t", '"a"'), ("12345678901234568", "8", "t", '"b"')])
    assert [(r.row_pos, r.message) for r in rules.v01_repeated_study(rows).collect()] == [(1, "Estudio 1.0 repetido")]
    assert [r.sample for r in rules.v20_sample_constant(rows).collect()] == ["t"]
    meta = spark.createDataFrame([("P", ["Pais"])], "project_id string, document_level array<string>")
    assert {r.document for r in rules.v02_document_constant(rows, meta).collect()} == {"7", "8"}


def test_large_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("12345678901234567",), ("123456789012345678901234567890",), ("-00012345678901234567",), ("7",)], "t string")
    assert [r.x for r in df.select(cell_text(typed_text("t")).alias("x")).collect()] == ["12345678901234567", "123456789012345678901234567890", "-12345678901234567", "7"]
    assert df.select(cells_equal(int_cell(F.lit(9007199254740993)), int_cell(F.lit(9007199254740992))).alias("e")).first().e is False


def test_the_finding_with_the_largest_number_decides(spark):
    rows = spark.createDataFrame([("P", "E", 0, {"Muestra": ("int", 1.0, None)})], f"project_id string, extraction_id string, row_pos int, fila map<string,{CELL}>")
    rows = rows.withColumn("traz", F.lit(None).cast(TRACE))
    judged = spark.createDataFrame([("P", "E", f"A|{n}", 0, "Muestra", "changed", ("int", float(n), None)) for n in range(1, 13)],
                                   f"project_id string, extraction_id string, finding_id string, row_pos int, column string, outcome string, value {CELL}").withColumn("evidence", F.lit(None).cast(EVIDENCE))
    assert reconcile.apply_decisions(rows, judged).first().fila["Muestra"]["num"] == 12.0
