"""Queries on the library, usage, codebooks, logs and streams, from documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.operators import library, norms, usage
from quoteloom.plans.on_matrix import _ACTS, actions, cells, columns
from quoteloom.plans.registry import Tables, query
from quoteloom.session import cut_lineage, shared_folder
from quoteloom.sources import codebooks as codebook_files
from quoteloom.sources import files as file_sources
from quoteloom.sources import logs, runs, sinks
from quoteloom.sources.sinks import write_files
from quoteloom.streaming import events as ev
from quoteloom.streaming import stateful
from quoteloom.streaming.run import drain, in_micro_batches

NOW = "2024-01-20 12:00:00"


# ------------------------------------------------------------------ files
def _files(t: Tables) -> DataFrame:
    """Documents as files of their language; short ones lack the mark of a PDF."""
    content = F.concat(F.when(F.col("n_chars") >= 200, "%PDF").otherwise("TEXT"), F.col("text"))
    name = F.concat((F.col("doc_id") % 40).cast("string"), F.lit(". Doc "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return file_sources.describe_files(t.documents.select(
        F.col("lang").alias("project_id"), name.alias("file_name"), content.cast("binary").alias("content"), F.col("doc_id").alias("arrival")))


_FILES = """f AS (SELECT lang AS project_id, (doc_id % 40) || '. Doc ' || doc_id || '.pdf' AS file_name, doc_id AS arrival, n_chars >= 200 AS is_pdf,
  sha256(CASE WHEN n_chars >= 200 THEN '%PDF' ELSE 'TEXT' END || text) AS sha256, doc_id % 40 AS document FROM documents),
firsts AS (SELECT project_id, sha256, min(arrival) AS a, arg_min(file_name, arrival) AS name FROM f WHERE is_pdf GROUP BY ALL)"""


@query("loaded_files", f"""WITH {_FILES} SELECT f.project_id, file_name, document, CASE WHEN NOT is_pdf THEN 'error' WHEN arrival = a THEN 'loaded' ELSE 'duplicate' END AS outcome,
  CASE WHEN is_pdf AND arrival <> a THEN name END AS duplicate_of FROM f LEFT JOIN firsts x ON x.project_id = f.project_id AND x.sha256 = f.sha256""")
def loaded_files(t: Tables) -> DataFrame:
    return file_sources.load_outcomes(_files(t)).select("project_id", "file_name", "document", "outcome", "duplicate_of")


@query("load_counts", f"""WITH {_FILES} SELECT f.project_id, CASE WHEN NOT is_pdf THEN 'error' WHEN arrival = a THEN 'loaded' ELSE 'duplicate' END AS outcome, count(*) AS n
FROM f LEFT JOIN firsts x ON x.project_id = f.project_id AND x.sha256 = f.sha256 GROUP BY ALL""")
def load_counts(t: Tables) -> DataFrame:
    return library.outcome_counts(file_sources.load_outcomes(_files(t)))


def _written_files(t: Tables) -> str:
    """The documents as files in one folder for each language."""
    folder = shared_folder(t.spark)
    content = F.concat(F.when(F.col("n_chars") >= 200, "%PDF").otherwise("TEXT"), F.col("text"))
    name = F.concat((F.col("doc_id") % 40).cast("string"), F.lit(". Doc "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    write_files(t.documents.select(F.concat_ws("/", "lang", name).alias("path"), content.alias("content")), folder)
    return folder


@query("folder_files", f"""WITH {_FILES}, named AS (SELECT project_id, sha256, min(file_name) AS name FROM f WHERE is_pdf GROUP BY ALL)
SELECT f.project_id, file_name, document, CASE WHEN NOT is_pdf THEN 'error' WHEN file_name = name THEN 'loaded' ELSE 'duplicate' END AS outcome,
  CASE WHEN is_pdf AND file_name <> name THEN name END AS duplicate_of FROM f LEFT JOIN named x ON x.project_id = f.project_id AND x.sha256 = f.sha256""")
def folder_files(t: Tables) -> DataFrame:
    """The documents written as files, and the folder loaded."""
    files = file_sources.load_folder(t.spark, _written_files(t))
    return file_sources.load_outcomes(files).select("project_id", "file_name", "document", "outcome", "duplicate_of")


@query("folder_stream", f"""WITH {_FILES} SELECT f.project_id, CASE WHEN NOT is_pdf THEN 'error' WHEN arrival = a THEN 'loaded' ELSE 'duplicate' END AS outcome, count(*) AS n
FROM f LEFT JOIN firsts x ON x.project_id = f.project_id AND x.sha256 = f.sha256 GROUP BY ALL""")
def folder_stream(t: Tables) -> DataFrame:
    """The same folder as a stream of three or four micro-batches; which of the copies comes first is left to their order."""
    folder, out = _written_files(t), shared_folder(t.spark)
    files = file_sources.stream_folder(t.spark, folder, at_once=1 + t.documents.count() // 3)
    file_sources.load_stream(files, f"{out}/ledger", f"{out}/state").awaitTermination()
    return library.outcome_counts(file_sources.ledger_outcomes(t.spark, f"{out}/ledger"))


@query("catalogue_duplicates", f"""WITH {_FILES}, before AS (SELECT project_id, sha256, min(file_name) AS name FROM f WHERE is_pdf AND arrival % 2 = 0 GROUP BY ALL)
SELECT f.project_id, count(*) FILTER (b.name IS NOT NULL) AS known, count(*) FILTER (b.name IS NULL) AS "new" FROM f LEFT JOIN before b ON b.project_id = f.project_id AND b.sha256 = f.sha256 WHERE is_pdf GROUP BY ALL""")
def catalogue_duplicates(t: Tables) -> DataFrame:
    """Files against a catalogue that holds those with an even number."""
    f = _files(t).filter("is_pdf")
    out = library.mark_duplicates(f, f.filter("arrival % 2 = 0"))
    old = f.filter("arrival % 2 = 0").select("project_id", "sha256").distinct().withColumn("old", F.lit(True))
    joined = out.join(old, ["project_id", "sha256"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
    return joined.filter("not old or outcome = 'duplicate'").groupBy("project_id").agg(F.count_if("old").alias("known"), F.count_if(~F.col("old")).alias("new"))


# ------------------------------------------------------------------ articles
_STATES = ["HEREDADO", "NUEVO", "CONVIRTIENDO", "LISTO", "EN_COLA", "EXTRAYENDO", "AUDITANDO", "POR_REVISAR", "APROBADO", "ERROR", "EXCLUIDO"]
_STATE_SQL = "[" + ", ".join(f"'{s}'" for s in _STATES) + "]"


def _moves(t: Tables) -> DataFrame:
    """Events as state changes: most follow the usual course, some jump."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    course = F.array(*map(F.lit, ["NUEVO", "CONVIRTIENDO", "LISTO", "EN_COLA", "EXTRAYENDO", "AUDITANDO", "POR_REVISAR", "EN_COLA"]))
    e = t.read("events").withColumn("n", order)
    new = (F.when((F.col("event_type") == "error") & (F.col("n") > 0), "ERROR").when((F.col("event_type") == "signup") & (F.col("n") % 5 == 3), "EXCLUIDO")
           .otherwise(F.get(course, (F.col("n") % 8).cast("int"))))
    return e.select(
        F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("article_id"), F.col("event_id").alias("seq"), F.col("ts"), new.alias("new_state"),
        F.when(F.col("event_id") % 2 == 0, "motivo").alias("reason"), F.when(new == "ERROR", "EXTRAYENDO").alias("step"))


_MOVES = f"""e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
moves AS (SELECT 'p' AS project_id, CAST(user_id AS STRING) AS article_id, event_id AS seq, CASE WHEN event_type = 'error' AND n > 0 THEN 'ERROR' WHEN event_type = 'signup' AND n % 5 = 3 THEN 'EXCLUIDO'
  ELSE ['NUEVO', 'CONVIRTIENDO', 'LISTO', 'EN_COLA', 'EXTRAYENDO', 'AUDITANDO', 'POR_REVISAR', 'EN_COLA'][n % 8 + 1] END AS new_state, event_id % 2 = 0 AS explained FROM e),
chain AS (SELECT *, lag(new_state) OVER (PARTITION BY article_id ORDER BY seq) AS prev_state FROM moves),
legal AS (SELECT * FROM (VALUES ('NUEVO', 'CONVIRTIENDO'), ('CONVIRTIENDO', 'LISTO'), ('LISTO', 'EN_COLA'), ('EN_COLA', 'EXTRAYENDO'), ('EN_COLA', 'LISTO'), ('EN_COLA', 'HEREDADO'), ('EXTRAYENDO', 'AUDITANDO'),
  ('AUDITANDO', 'POR_REVISAR'), ('POR_REVISAR', 'APROBADO'), ('POR_REVISAR', 'EN_COLA'), ('APROBADO', 'EN_COLA'), ('HEREDADO', 'EN_COLA'), ('EXCLUIDO', 'NUEVO'), ('EXCLUIDO', 'HEREDADO')) v(a, b)),
checked AS (SELECT c.*, CASE WHEN prev_state IS NULL THEN new_state IN ('NUEVO', 'HEREDADO')
  WHEN prev_state = 'ERROR' THEN new_state IN ('ERROR', 'EXCLUIDO', 'NUEVO', 'LISTO', 'HEREDADO', 'POR_REVISAR', 'APROBADO', 'EXTRAYENDO')
  WHEN new_state = 'ERROR' THEN prev_state <> 'EXCLUIDO' WHEN new_state = 'EXCLUIDO' THEN prev_state IN ('NUEVO', 'LISTO', 'HEREDADO', 'ERROR')
  ELSE EXISTS (SELECT 1 FROM legal WHERE a = prev_state AND b = new_state) END AS ok FROM chain c),
problems AS (SELECT project_id, article_id, seq, prev_state, new_state, CASE WHEN NOT ok THEN 'Transición inválida: ' || coalesce(prev_state, '-') || ' → ' || new_state
  WHEN new_state = 'EXCLUIDO' AND NOT explained THEN 'Excluir exige motivo' END AS problem FROM checked)"""


def _articles(t: Tables) -> DataFrame:
    d = t.documents
    return d.select(
        F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("article_id"), F.concat(F.col("source"), F.lit("_"), (F.col("doc_id") % 7).cast("string"), F.lit(".pdf")).alias("file_name"),
        F.get(F.array(*map(F.lit, _STATES)), (F.col("n_chars") % 11).cast("int")).alias("state"), (F.col("doc_id") % 3 > 0).alias("has_document"),
        F.get(F.array(F.lit("HEREDADO"), F.lit("POR_REVISAR"), F.lit("LISTO")), (F.col("doc_id") % 4).cast("int")).alias("prev_state"), F.col("n_chars").alias("pages"),
        F.when(F.col("doc_id") % 5 > 1, "EXTRAYENDO").when(F.col("doc_id") % 5 == 1, "CONVIRTIENDO").alias("step"), (F.col("doc_id") % 2 == 0).alias("confirmed"),
        F.when(F.col("doc_id") % 6 == 0, "porque").alias("reason"), F.when(F.col("doc_id") % 7 > 1, F.col("doc_id")).alias("covidence"),
        F.when(F.col("doc_id") % 3 == 0, "Otros").otherwise("Covidence").alias("route"))


_ARTICLES = f"""a AS (SELECT lang AS project_id, CAST(doc_id AS STRING) AS article_id, doc_id, source || '_' || (doc_id % 7) || '.pdf' AS file_name, {_STATE_SQL}[n_chars % 11 + 1] AS state, doc_id % 3 > 0 AS has_document,
  ['HEREDADO', 'POR_REVISAR', 'LISTO', NULL][doc_id % 4 + 1] AS prev_state, n_chars AS pages FROM documents)"""


@query("state_counts", f"""WITH {_ARTICLES}, s AS (SELECT unnest({_STATE_SQL}) AS state), p AS (SELECT DISTINCT project_id FROM a)
SELECT p.project_id, s.state, count(a.article_id) AS n FROM p CROSS JOIN s LEFT JOIN a ON a.project_id = p.project_id AND a.state = s.state GROUP BY ALL""")
def state_counts(t: Tables) -> DataFrame:
    return library.state_counts(_articles(t))


@query("listed_articles", f"""WITH {_ARTICLES} SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY sort_key, file_name, article_id) AS rank FROM (SELECT project_id, article_id, file_name, 'src' || lpad(length(regexp_extract(file_name, 'src(\\d+)', 1))::varchar, 10, '0') || regexp_extract(file_name, 'src(\\d+)', 1) || '_' || lpad('1', 10, '0') || regexp_extract(file_name, '_(\\d)', 1) || '.pdf' AS sort_key
FROM a WHERE state = 'LISTO' AND contains(file_name, 'c1'))""")
def listed_articles(t: Tables) -> DataFrame:
    return library.list_articles(_articles(t), "LISTO", "C1").select("project_id", "article_id", "file_name", "sort_key", "rank")


@query("illegal_moves", f"WITH {_MOVES} SELECT * FROM problems WHERE problem IS NOT NULL")
def illegal_moves(t: Tables) -> DataFrame:
    return library.illegal_moves(_moves(t))


@query("current_states", f"""WITH {_MOVES} SELECT project_id, article_id, arg_max(new_state, seq) AS state, arg_max(prev_state, seq) FILTER (new_state IN ('EN_COLA', 'EXCLUIDO') AND prev_state IS NOT NULL) AS prev_state,
  CASE WHEN arg_max(new_state, seq) = 'ERROR' THEN 'EXTRAYENDO' END AS step, count(*) AS changes FROM chain GROUP BY ALL""")
def current_states(t: Tables) -> DataFrame:
    return library.current_states(_moves(t)).select("project_id", "article_id", "state", "prev_state", F.col("error.step").alias("step"), "changes")


@query("reset_errors", f"""WITH {_ARTICLES} SELECT project_id, article_id, CASE WHEN NOT has_document THEN 'NUEVO' WHEN prev_state IN ('HEREDADO', 'POR_REVISAR', 'APROBADO') THEN prev_state ELSE 'LISTO' END AS target
FROM a WHERE state = 'ERROR'""")
def reset_errors(t: Tables) -> DataFrame:
    return library.reset_errors(_articles(t)).select("project_id", "article_id", "target")


@query("queue_requests", f"""WITH {_ARTICLES}, r AS (SELECT *, CASE WHEN state IN ('NUEVO', 'CONVIRTIENDO', 'LISTO', 'HEREDADO', 'ERROR', 'POR_REVISAR') THEN CASE
  WHEN state = 'POR_REVISAR' AND doc_id % 2 <> 0 THEN '«' || file_name || '» ya tiene filas por revisar: confirme la reextracción' WHEN doc_id % 7 <= 1 AND doc_id % 3 <> 0
  THEN '«' || file_name || '»: falta Covidence #. Indíquelo, o elija otra vía de identificación si el artículo no pasó por Covidence' END
  ELSE '«' || file_name || '» está en estado ' || state || ' y no se puede extraer ahora' END AS refusal FROM a)
SELECT project_id, article_id, refusal IS NULL AS queued, refusal FROM r""")
def queue_requests(t: Tables) -> DataFrame:
    a = _articles(t)
    return library.queue_requests(a.select("project_id", "article_id", "covidence", "route", "confirmed", "reason"), a)


@query("requeue_refusals", f"""WITH {_ARTICLES} SELECT project_id, article_id, CASE WHEN state NOT IN ('LISTO', 'HEREDADO', 'ERROR', 'POR_REVISAR', 'APROBADO') THEN 'Transición inválida: ' || state || ' → EN_COLA'
  WHEN NOT has_document THEN 'El artículo no tiene documento estructurado: conviértalo antes de extraer' WHEN state IN ('POR_REVISAR', 'APROBADO') AND doc_id % 2 <> 0 THEN 'Reextraer exige confirmación'
  WHEN state = 'APROBADO' AND doc_id % 6 <> 0 THEN 'Reextraer un artículo aprobado exige motivo' WHEN state = 'ERROR' AND doc_id % 5 <= 1 THEN 'El error no ocurrió al extraer: use reintentar()' END AS refusal FROM a""")
def requeue_refusals(t: Tables) -> DataFrame:
    return library.requeue_refusal(_articles(t))


@query("stalled_articles", f"""WITH {_ARTICLES} SELECT project_id, article_id FROM a WHERE state IN ('CONVIRTIENDO', 'EN_COLA', 'EXTRAYENDO', 'AUDITANDO') AND doc_id % 3 <> 1""")
def stalled_articles(t: Tables) -> DataFrame:
    jobs = t.documents.filter("doc_id % 3 = 1").select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("article_id"))
    return library.stalled_articles(_articles(t), jobs).select("project_id", "article_id")


@query("isolation_breaches", """SELECT l.doc_id, d.lang AS project_id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 0""")
def isolation_breaches(t: Tables) -> DataFrame:
    """Labels of bad quality are filed under another project than their document."""
    own = t.read("labels").join(t.documents.select("doc_id", "lang"), "doc_id")
    child = own.select(F.when(F.col("quality") == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang")).alias("project_id"), "doc_id", "lang")
    return library.isolation_breaches(child, t.documents.select(F.col("lang").alias("project_id"), "doc_id"), "doc_id").select("doc_id", F.col("lang").alias("project_id"))


# ------------------------------------------------------------------ usage
_ROLE = "CASE event_type WHEN 'view' THEN 'extractor' WHEN 'click' THEN 'auditor' WHEN 'error' THEN 'ciego' ELSE 'conciliador' END"
_CALLS_EXPR = ["CAST(user_id % 5 AS STRING) AS project_id", "CAST(user_id AS STRING) AS extraction_id", f"{_ROLE} AS role",
               "CASE WHEN event_id % 3 = 0 THEN 'ligero' WHEN event_id % 3 = 1 THEN 'grande' END AS model", "CAST(floor(value) AS INT) AS input",
               "CAST(floor(value * 2) AS INT) AS cache_write", "CAST(event_id % 100 AS INT) AS cache_read", "1 AS output", "floor(value) / 8 AS cost_usd", "floor(value) / 4 AS seconds"]
CALLS = f"calls AS (SELECT {', '.join(_CALLS_EXPR)} FROM events)"


def _calls(t: Tables) -> DataFrame:
    return t.read("events").selectExpr(*_CALLS_EXPR)


def _extractions(t: Tables) -> DataFrame:
    """Each purchase or view of a user is a run; articles are the hundredths of the value."""
    return t.read("events").filter("event_type in ('view', 'purchase')").selectExpr(
        "CAST(user_id % 5 AS STRING) AS project_id", "CAST(user_id AS STRING) AS article_id", "CAST(event_id AS STRING) AS extraction_id", "ts AS started",
        "CASE WHEN event_id % 9 <> 0 THEN ts + INTERVAL 10 MINUTES END AS ended", "CASE WHEN event_type = 'view' THEN 'COMPLETADA' ELSE 'FALLIDA' END AS state", "CAST(floor(value * 100) AS BIGINT) AS tokens",
        "CASE WHEN event_id % 4 <> 0 THEN named_struct('document', event_id % 50, 'first_study', event_id, 'covidence', CASE WHEN event_id % 3 = 0 THEN event_id END, 'route', CASE WHEN event_id % 5 = 0 THEN 'Otros' END) END AS input")


EXTRACTIONS = """x AS (SELECT CAST(user_id % 5 AS STRING) AS project_id, CAST(user_id AS STRING) AS article_id, CAST(event_id AS STRING) AS extraction_id, event_id, ts AS started,
  CASE WHEN event_id % 9 <> 0 THEN ts + INTERVAL 10 MINUTES END AS ended, CASE WHEN event_type = 'view' THEN 'COMPLETADA' ELSE 'FALLIDA' END AS state, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events WHERE event_type IN ('view', 'purchase'))"""


@query("usage_by_role", f"""WITH {CALLS} SELECT project_id, extraction_id, role, count(*) AS calls, sum(input)::BIGINT AS input, sum(cache_write)::BIGINT AS cache_write, sum(cache_read)::BIGINT AS cache_read, sum(output)::BIGINT AS output,
  CAST(round_even(sum(cost_usd), 4) AS DOUBLE) AS cost_usd, CAST(round_even(sum(seconds), 1) AS DOUBLE) AS seconds, count(*) FILTER (model = 'ligero') AS light_calls FROM calls GROUP BY ALL""")
def usage_by_role(t: Tables) -> DataFrame:
    out = usage.usage_by_role(_calls(t))
    return out.withColumn("light_calls", F.coalesce(F.try_element_at("models", F.lit("ligero")), F.lit(0))).drop("models")


@query("extraction_totals", f"""WITH {CALLS} SELECT project_id, extraction_id, sum(input + cache_write + cache_read + output)::BIGINT AS tokens FROM calls GROUP BY ALL""")
def extraction_totals(t: Tables) -> DataFrame:
    return usage.extraction_totals(usage.usage_by_role(_calls(t))).drop("cost_usd")


@query("month_tokens", f"""WITH {EXTRACTIONS} SELECT project_id, sum(tokens)::BIGINT AS tokens FROM x WHERE ended IS NULL OR ended >= date_trunc('month', TIMESTAMP '{NOW}') GROUP BY ALL""")
def month_tokens(t: Tables) -> DataFrame:
    return usage.month_tokens(_extractions(t), F.lit(NOW).cast("timestamp"))


@query("latest_extractions", f"""WITH {EXTRACTIONS} SELECT project_id, article_id, arg_max(extraction_id, started) AS extraction_id, arg_max(state, started) AS state FROM x GROUP BY ALL""")
def latest_extractions(t: Tables) -> DataFrame:
    return usage.latest_per_article(_extractions(t)).select("project_id", "article_id", "extraction_id", "state")


@query("latest_completed", f"""WITH {EXTRACTIONS} SELECT project_id, article_id, arg_max(extraction_id, started) AS extraction_id FROM x WHERE state = 'COMPLETADA' GROUP BY ALL""")
def latest_completed(t: Tables) -> DataFrame:
    return usage.latest_per_article(_extractions(t), True).select("project_id", "article_id", "extraction_id")


_ESTIMATE = f"""{EXTRACTIONS}, l AS (SELECT project_id, article_id, arg_max(state, started) AS state, arg_max(tokens, started) AS tokens FROM x GROUP BY ALL),
est AS (SELECT p.project_id, coalesce(CAST(round_even(avg(l.tokens), 0) AS BIGINT), 587719) AS estimate FROM (SELECT DISTINCT project_id FROM x) p
  LEFT JOIN l ON l.project_id = p.project_id AND l.state = 'COMPLETADA' AND l.tokens > 0 AND l.project_id <> '0' GROUP BY p.project_id)"""


def _estimates(t: Tables) -> DataFrame:
    x = _extractions(t)
    return usage.tokens_per_article(x.filter("project_id <> '0'"), x.select("project_id").distinct())


@query("tokens_per_article", f"WITH {_ESTIMATE} SELECT project_id, estimate FROM est")
def tokens_per_article(t: Tables) -> DataFrame:
    """Project 0 has no completed run here, so it takes the constant."""
    return _estimates(t)


@query("budget_gate", f"""WITH {_ESTIMATE}, u AS (SELECT project_id, sum(tokens) AS tokens FROM x GROUP BY ALL)
SELECT est.project_id, (2 + CAST(est.project_id AS INT))::BIGINT AS articles, CAST(tokens + (2 + CAST(est.project_id AS INT)) * estimate AS BIGINT) AS needed, CASE WHEN est.project_id <> '1' THEN 20000000::BIGINT END AS cap,
  est.project_id = '1' OR tokens + (2 + CAST(est.project_id AS INT)) * estimate <= 20000000 AS accepted FROM est JOIN u USING (project_id)""")
def budget_gate(t: Tables) -> DataFrame:
    x = _extractions(t)
    used = x.groupBy("project_id").agg(F.sum("tokens").alias("tokens"))
    requests = x.select("project_id").distinct().select("project_id", (2 + F.col("project_id").cast("int")).alias("articles"), F.when(F.col("project_id") != "1", F.lit(20000000).cast("bigint")).alias("cap"))
    return usage.budget_gate(requests, used, _estimates(t))


@query("recent_extractions", f"""WITH {EXTRACTIONS} SELECT project_id, article_id, extraction_id FROM x WHERE ended IS NULL OR ended >= TIMESTAMP '{NOW}' - INTERVAL 15 MINUTES""")
def recent_extractions(t: Tables) -> DataFrame:
    return usage.recent_extractions(_extractions(t), F.lit(NOW).cast("timestamp")).select("project_id", "article_id", "extraction_id")


@query("models_of_latest", f"""WITH {EXTRACTIONS}, l AS (SELECT project_id, article_id, arg_max(extraction_id, started) AS extraction_id FROM x GROUP BY ALL), r AS (SELECT unnest(['extractor', 'auditor', 'ciego', 'conciliador']) AS role)
SELECT l.project_id, l.article_id, r.role, CASE WHEN (CAST(l.extraction_id AS INT) % 4 + 1) = CASE r.role WHEN 'extractor' THEN 1 WHEN 'auditor' THEN 2 WHEN 'ciego' THEN 3 ELSE 4 END THEN 1 ELSE 0 END::BIGINT AS models, TRUE AS recorded FROM l CROSS JOIN r""")
def models_of_latest(t: Tables) -> DataFrame:
    """One call per run, of the role its number gives."""
    x = _extractions(t)
    role = F.get(F.array(*map(F.lit, ["extractor", "auditor", "ciego", "conciliador"])), (F.col("extraction_id").cast("int") % 4))
    calls = x.select("project_id", "extraction_id", role.alias("role"), F.lit("m").alias("model"), *[F.lit(1).alias(f) for f in usage.TOKEN_FIELDS], F.lit(0.5).alias("cost_usd"), F.lit(1.0).alias("seconds"))
    out = usage.models_of_latest(x, usage.usage_by_role(calls))
    return out.select("project_id", "article_id", "role", F.coalesce(F.size("models"), F.lit(0)).alias("models"), "recorded")


@query("relaunch_inputs", """WITH e AS (SELECT CAST(user_id % 5 AS STRING) AS project_id, CAST(user_id AS STRING) AS article_id, event_id, ts FROM events WHERE event_type IN ('view', 'purchase')),
l AS (SELECT project_id, article_id, arg_max(event_id, ts) FILTER (event_id % 4 <> 0) AS k FROM e GROUP BY ALL)
SELECT project_id, article_id, k % 50 AS document, k IS NULL OR (k % 3 <> 0 AND k % 5 <> 0) AS incomplete FROM l""")
def relaunch_inputs(t: Tables) -> DataFrame:
    x = _extractions(t)
    out = usage.relaunch_inputs(x.select("project_id", "article_id").distinct(), x)
    return out.select("project_id", "article_id", F.col("input.document").alias("document"), "incomplete")


@query("library_projection", f"""WITH {_ARTICLES} SELECT project_id, count(*) AS articles, sum(pages)::BIGINT AS pages, round(sum(pages) * 11.2 / 3600, 6) AS hours_low, round(sum(pages) * 21.2 / 3600, 6) AS hours_high, round(CAST(count(*) * 2.64 AS DOUBLE), 6) AS cost_usd FROM a GROUP BY ALL""")
def library_projection(t: Tables) -> DataFrame:
    out = usage.library_projection(_articles(t), (11.2, 21.2), 2.64)
    return out.withColumns({c: F.round(c, 6) for c in ("hours_low", "hours_high", "cost_usd")})


# ------------------------------------------------------------------ logs and runs
def _log_lines(t: Tables) -> DataFrame:
    """Events as log lines; signups are cut in the middle."""
    e = t.read("events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").otherwise("INFO")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t"), level.alias("nivel"), F.concat(F.lit("origen"), (F.col("user_id") % 4).cast("string")).alias("origen"),
                              F.concat(F.lit("Mensaje "), F.col("props")).alias("mensaje")))
    return e.select("event_id", F.when(F.col("event_type") == "signup", F.substring(line, 1, 20)).otherwise(line).alias("value"))


_LOG = """g AS (SELECT event_id, ts AS t, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS nivel, 'origen' || (user_id % 4) AS origen, 'Mensaje ' || props AS mensaje FROM events WHERE event_type <> 'signup')"""


@query("parsed_log", f"WITH {_LOG} SELECT event_id, epoch_us(t) AS micros, nivel, origen, mensaje FROM g")
def parsed_log(t: Tables) -> DataFrame:
    return logs.parse_log(_log_lines(t)).select("event_id", F.unix_micros("t").alias("micros"), "nivel", "origen", "mensaje")


@query("log_tail", f"WITH {_LOG} SELECT event_id, nivel FROM g ORDER BY event_id DESC LIMIT 300")
def log_tail(t: Tables) -> DataFrame:
    return logs.tail(logs.parse_log(_log_lines(t)), "event_id").select("event_id", "nivel")


@query("log_after_cursor", f"WITH {_LOG} SELECT event_id, nivel FROM g WHERE event_id > 777 ORDER BY event_id LIMIT 500")
def log_after_cursor(t: Tables) -> DataFrame:
    return logs.after(logs.parse_log(_log_lines(t)), "event_id", 777).select("event_id", "nivel")


@query("filtered_log", f"WITH {_LOG} SELECT event_id, nivel, mensaje FROM g WHERE nivel IN ('WARNING', 'ERROR') AND origen = 'origen1' AND contains(lower(mensaje), '\"k\": 1')")
def filtered_log(t: Tables) -> DataFrame:
    return usage.filter_log(logs.parse_log(_log_lines(t)), "WARNING", "origen1", ' "K": 1').select("event_id", "nivel", "mensaje")


@query("log_origins", f"WITH {_LOG} SELECT origen, count(*) AS lines, count(*) FILTER (nivel = 'ERROR') AS errors FROM g GROUP BY ALL")
def log_origins(t: Tables) -> DataFrame:
    return usage.log_origins(logs.parse_log(_log_lines(t)))


def _run_lines(t: Tables) -> DataFrame:
    """Events of a user as the output lines of a run: limit news, results, noise."""
    e = t.read("events")
    info = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, "rejected").otherwise("allowed").alias("status"), F.struct(
        F.struct((F.floor("value") / 256).alias("utilization"), (F.lit(1700000000) + F.col("event_id")).alias("resetsAt")).alias("five_hour"),
        F.struct(F.lit(0.5).alias("utilization"), F.lit(1800000000).alias("resetsAt")).alias("seven_day")).alias("unifiedWindows")))
    line = (F.when(F.col("event_type") == "click", F.concat(F.lit('{"type": "rate_limit_event", "rate_limit_info": '), info, F.lit("}")))
            .when(F.col("event_type") == "view", F.concat(F.lit(' {"type": "result", "result": "r'), F.col("event_id").cast("string"), F.lit('"}')))
            .when(F.col("event_type") == "error", '{"type": "result", cut').otherwise("text"))
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


_RUNS = """r AS (SELECT user_id AS run_id, 'r' || max(event_id) FILTER (event_type = 'view') AS result, max(event_id) FILTER (event_type = 'click') AS k, arg_max(value, event_id) FILTER (event_type = 'click') AS val FROM events GROUP BY user_id)"""


@query("run_results", f"WITH {_RUNS} SELECT run_id, result, CASE WHEN k IS NULL THEN NULL WHEN k % 5 = 0 THEN 'rejected' ELSE 'allowed' END AS status FROM r")
def run_results(t: Tables) -> DataFrame:
    out = runs.run_results(_run_lines(t))
    return out.select("run_id", F.get_json_object("result", "$.result").alias("result"), F.get_json_object("info", "$.status").alias("status"))


@query("quota_windows", f"""WITH {_RUNS} SELECT run_id, CAST(round_even(floor(val) / 256 * 100, 1) AS DOUBLE) AS used_5h, CASE WHEN k IS NOT NULL THEN 50.0::DOUBLE END AS used_7d, coalesce(k % 5 = 0, FALSE) AS blocked,
  coalesce(k % 5 = 0, FALSE) OR run_id % 10 = 0 AS exhausted, CASE WHEN (k % 5 = 0 OR run_id % 10 = 0) AND floor(val) / 256 >= 1 THEN 1700000000 + k END AS resets_at FROM r""")
def quota_windows(t: Tables) -> DataFrame:
    found = runs.run_results(_run_lines(t)).withColumn("message", F.when(F.col("run_id") % 10 == 0, "You hit your LIMIT: usage limit"))
    return usage.quota_windows(found).select("run_id", "used_5h", "used_7d", "blocked", "exhausted", F.unix_seconds("resets_at").alias("resets_at"))


# ------------------------------------------------------------------ codebooks: each document gives one
def _books(t: Tables) -> DataFrame:
    """A codebook per document: its first words are column names, its length sets faults."""
    first = F.slice(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]+", " ")), " +"), lambda w: w != "")), 1, 6)
    words = F.col("words")
    defs = F.transform(words, lambda w, i: F.concat(
        F.lit('"'), w, F.lit('": {"posicion": '), F.when((F.col("n_chars") % 5 == 0) & (i == 1), 1).otherwise(i + 1).cast("string"), F.lit(', "letra_excel": "'), F.substring(F.lit("ABCDEF"), 1, 1),
        F.lit('", "encabezado_original": "'), F.upper(w), F.when((F.col("n_chars") % 7 == 0) & (i == 0), '"').otherwise('", "descripcion": "Columna trazabilidad.id_muestra que es null"'),
        F.lit(', "instruccion_operativa": {"tipo_de_dato": "'), F.when(i == 0, "entero").otherwise("texto"), F.lit('", "obligatorio": true, "requiere_evidencia": false, "nivel_de_registro": "Documento", "codigo_si_falta": "No indica", "valores_permitidos": '),
        F.when(i == 2, '["a", "b"]').otherwise('"libre"'), F.lit(', "regla_de_decision": "usar metodo_r o id_muestra"}}')))
    body = F.concat(F.lit('{"columnas": {'), F.array_join(defs, ", "), F.lit('}, "esquema_de_salida": {}, "vocabularios_controlados": {}, '), F.when(F.col("n_chars") % 3 > 0, '"validaciones_automaticas": [], ').otherwise(""),
                    F.lit('"trazabilidad_por_fila": {"campos": {"metodo_r": "cómo", "id_muestra": "cuál", "otro": "nada"}}, "como_se_construye_cada_fila": {"regla_para_abrir_una_fila_nueva": ["una", "dos"]}, '),
                    F.lit('"protocolo_de_extraccion": {"principios_de_veracidad": ["no inventar", "es null si falta"]}}'))
    named = t.documents.select(F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("codebook_id"), "n_chars", first.alias("words"))
    return named.select("project_id", "codebook_id", "n_chars", F.when(F.size(words) >= 6, body).otherwise("{").alias("content"))


def _stored_books(t: Tables) -> DataFrame:
    """The sound codebooks as a stored table: what several branches read is derived from the documents once."""
    told = _books(t).withColumn("sound", F.try_parse_json("content").isNotNull())  # a filter would spell the content out once more
    return cut_lineage(told).filter("sound").drop("sound")


_BOOKS = """w AS (SELECT lang AS project_id, CAST(doc_id AS STRING) AS codebook_id, doc_id, n_chars, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' +'), lambda x: x <> '') AS l FROM documents),
d AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM w), b AS (SELECT *, u[1:6] AS k FROM d WHERE len(u) >= 6)"""


@query("codebook_columns", f"""WITH {_BOOKS}, e AS (SELECT *, unnest(range(1, 7)) AS i FROM b) SELECT project_id, codebook_id, k[i] AS key, upper(k[i]) AS header, CASE WHEN n_chars % 5 = 0 AND i = 2 THEN 1 ELSE i END AS position,
  CASE WHEN i = 1 THEN 'entero' ELSE 'texto' END AS data_type, CASE WHEN i = 3 THEN 2 END::BIGINT AS allowed, i = 1 AS is_numeric FROM e""")
def codebook_columns(t: Tables) -> DataFrame:
    out = norms.derive_columns(codebook_files.valid_json(_books(t)))
    return out.select("project_id", "codebook_id", "key", "header", "position", "data_type", F.when(F.col("allowed").isNotNull(), F.size("allowed")).alias("allowed"), "is_numeric")


@query("invalid_codebooks", f"""WITH {_BOOKS} SELECT project_id, codebook_id FROM d WHERE len(u) < 6""")
def invalid_codebooks(t: Tables) -> DataFrame:
    return codebook_files.invalid_json(_books(t)).select("project_id", "codebook_id")


@query("codebook_problems", f"""WITH {_BOOKS} SELECT project_id, codebook_id, 'falta la sección validaciones_automaticas' AS problem FROM b WHERE n_chars % 3 = 0
UNION ALL SELECT project_id, codebook_id, 'La columna ''' || k[1] || ''' no tiene ''descripcion''' FROM b WHERE n_chars % 7 = 0
UNION ALL SELECT project_id, codebook_id, 'Hay columnas con la misma posición: 1' FROM b WHERE n_chars % 5 = 0""")
def codebook_problems(t: Tables) -> DataFrame:
    return norms.structure_problems(codebook_files.valid_json(_books(t)))


@query("canonical_hash", """SELECT event_id, sha256('{"a":1.0,"k":' || json_extract_string(props, '$.k') || '}') AS hash FROM events""")
def canonical_hash(t: Tables) -> DataFrame:
    text = F.concat(F.lit(' {"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": 1.0} '))
    return t.read("events").select("event_id", norms.canonical_hash(text).alias("hash"))


def _published(t: Tables) -> DataFrame:
    """One codebook per user from the key of its first event; the active version has that of its last."""
    e = t.read("events").groupBy(F.col("user_id").cast("string").alias("project_id")).agg(F.min_by("props", "event_id").alias("first"), F.max_by("props", "event_id").alias("last"))
    versions = e.select("project_id", F.lit("v1").alias("codebook_id"), norms.canonical_hash("last").alias("hash"), F.lit(True).alias("active"), F.lit(NOW).cast("timestamp").alias("published"))
    incoming = e.select("project_id", F.lit("v2").alias("codebook_id"), F.when(F.col("project_id").cast("int") % 2 == 0, F.col("last")).otherwise(F.col("first")).alias("content"), F.lit(NOW).cast("timestamp").alias("published"))
    return norms.publish(versions, incoming)


_PUBLISHED = """e AS (SELECT CAST(user_id AS STRING) AS project_id, user_id, arg_min(props, event_id) AS f, arg_max(props, event_id) AS l FROM events GROUP BY user_id), n AS (SELECT *, user_id % 2 = 1 AND f <> l AS fresh FROM e)"""


@query("published_codebooks", f"""WITH {_PUBLISHED} SELECT project_id, 'v1' AS codebook_id, NOT fresh AS active FROM n UNION ALL SELECT project_id, 'v2', TRUE FROM n WHERE fresh""")
def published_codebooks(t: Tables) -> DataFrame:
    return _published(t).select("project_id", "codebook_id", "active")


@query("not_one_active", """SELECT CAST(user_id % 5 AS STRING) AS project_id, count(*) FILTER (event_type = 'view' AND event_id % 500 = 0) AS active_versions FROM events GROUP BY ALL HAVING count(*) FILTER (event_type = 'view' AND event_id % 500 = 0) <> 1""")
def not_one_active(t: Tables) -> DataFrame:
    return norms.not_one_active(t.read("events").select((F.col("user_id") % 5).cast("string").alias("project_id"), ((F.col("event_type") == "view") & (F.col("event_id") % 500 == 0)).alias("active")))


@query("header_notes", f"""WITH {_BOOKS}, e AS (SELECT *, unnest(range(1, 7)) AS i FROM b) SELECT project_id, codebook_id, k[i] AS key, sha256(concat_ws(chr(10), 'A. ' || k[i], '', 'PARA QUÉ SIRVE',
  'Columna trazabilidad.id_muestra que es null', '', 'CÓMO LLENARLA', 'usar metodo_r o id_muestra', CASE WHEN i = 3 THEN 'Valores permitidos: a; b' END, '', 'TIPO DE DATO Y NIVEL',
  CASE WHEN i = 1 THEN 'entero' ELSE 'texto' END || '; obligatoria; nivel Documento', '', 'SI EL DATO NO ESTÁ', 'No indica', '', 'EJEMPLO (Kumar, 2022, verificado)', 'celda vacía', '',
  'Nota: el registro de trazabilidad es la hoja Trazabilidad que genera la skill (página, ubicación y cita de cada dato).')) AS note_hash FROM e WHERE NOT (n_chars % 7 = 0 AND i = 1)""")
def header_notes(t: Tables) -> DataFrame:
    sound = _stored_books(t)
    notes = norms.header_notes(sound).filter("note like '%Columna%'")
    return notes.select("project_id", "codebook_id", "key", F.sha2("note", 256).alias("note_hash"))


@query("codebook_guide", f"""WITH {_BOOKS}, e AS (SELECT *, unnest(range(1, 7)) AS i FROM b) SELECT project_id, codebook_id, k[i] AS key, 'regla_de_decision' AS entry, 'usar metodo_r o id_muestra' AS text FROM e
UNION ALL SELECT project_id, codebook_id, k[i], 'codigo_si_falta', 'No indica' FROM e
UNION ALL SELECT project_id, codebook_id, k[i], 'para_que_sirve', 'Columna el registro de trazabilidad (id muestra) que está vacía' FROM e WHERE NOT (n_chars % 7 = 0 AND i = 1)""")
def codebook_guide(t: Tables) -> DataFrame:
    return norms.guide(codebook_files.valid_json(_books(t))).select("project_id", "codebook_id", "key", "entry", "text")


@query("codebook_protocol", f"""WITH {_BOOKS} SELECT project_id, codebook_id, e.entry, e.item_no::BIGINT AS item_no, e.text FROM b, (VALUES ('principios_de_veracidad', 0, 'no inventar'), ('principios_de_veracidad', 1, 'está vacía si falta'),
  ('regla_para_abrir_una_fila_nueva', 0, 'una'), ('regla_para_abrir_una_fila_nueva', 1, 'dos')) e(entry, item_no, text)""")
def codebook_protocol(t: Tables) -> DataFrame:
    return norms.protocol(codebook_files.valid_json(_books(t))).select("project_id", "codebook_id", "entry", "item_no", "text")


@query("named_trace_fields", f"""WITH {_BOOKS}, e AS (SELECT *, unnest(k) AS key FROM b) SELECT project_id, codebook_id, key, 'metodo_r' AS field, 'cómo' AS description FROM e""")
def named_trace_fields(t: Tables) -> DataFrame:
    return norms.named_trace_fields(_stored_books(t))


@query("rules_for_fields", f"""WITH {_BOOKS} SELECT project_id, codebook_id, f.field, f.rule FROM b, (VALUES ('número de filas', '["una","dos"]'), ('metodo_r', 'cómo'), ('ajeno', '{{"campos":{{"metodo_r":"cómo","id_muestra":"cuál","otro":"nada"}}}}')) f(field, rule)
UNION ALL SELECT project_id, codebook_id, '=columna', 'usar metodo_r o id_muestra' FROM b""")
def rules_for_fields(t: Tables) -> DataFrame:
    books = _stored_books(t)
    first = norms.column_entries(books).filter("c.posicion = 1").groupBy("project_id", "codebook_id").agg(F.min("key").alias("first"))
    named = F.explode(F.array(F.lit("número de filas"), F.lit("metodo_r"), F.lit("ajeno")))
    fields = books.select("project_id", "codebook_id", named.alias("field")).unionByName(first.select("project_id", "codebook_id", F.col("first").alias("field")))
    out = norms.rules_for_fields(fields, books).join(first, ["project_id", "codebook_id"])
    own = F.col("field") == F.col("first")
    return out.select("project_id", "codebook_id", F.when(own, "=columna").otherwise(F.col("field")).alias("field"), F.when(own, F.get_json_object("rule", "$.regla_de_decision")).otherwise(F.col("rule")).alias("rule"))


# ------------------------------------------------------------------ sinks
@query("written_tables", """SELECT lang AS project_id, source, count(*) AS n FROM documents GROUP BY ALL""")
def written_tables(t: Tables) -> DataFrame:
    """A table written per project and read back."""
    folder = shared_folder(t.spark)
    sinks.write_tables({"documents": t.documents.select(F.col("lang").alias("project_id"), "source", "doc_id")}, folder)
    return t.spark.read.parquet(f"{folder}/documents").groupBy("project_id", "source").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ streams over the event and document tables
@query("stream_dedup", """SELECT lang AS project_id, count(DISTINCT sha256(text)) AS files FROM documents GROUP BY ALL""")
def stream_dedup(t: Tables) -> DataFrame:
    """Copies within 30 days of the first file. All files arrive on the second day of time, at a second their number gives, so none is late
    and none comes after its 30 days, whatever the numbers are. A missing text is no file."""
    second = F.lit(86400) + F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(86400))
    files = t.stream("documents").select(
        F.col("lang").alias("project_id"), library.fingerprint("text").alias("sha256"), F.timestamp_seconds(second).alias("arrived"))
    return drain(ev.dedup_files(files, "30 days")).groupBy("project_id").agg(F.count("sha256").alias("files"))


@query("stream_lifecycle", f"WITH {_MOVES} SELECT * FROM problems")
def stream_lifecycle(t: Tables) -> DataFrame:
    """Changes in five micro-batches, up to ten minutes out of order; a change is a second after the one before it, the first after the start of time."""
    moves = _moves(t).withColumn("at", F.timestamp_seconds(F.col("seq") + 1))
    return drain(stateful.lifecycle_stream(in_micro_batches(moves, "at", 5, 600), "10 minutes"))


@query("stream_review", f"WITH {_ACTS} SELECT project_id, study, key, seq, action, refusal FROM judged")
def stream_review(t: Tables) -> DataFrame:
    """Actions in five micro-batches, up to ten minutes out of order."""
    acts = in_micro_batches(actions(t).withColumn("at", F.timestamp_seconds(F.col("seq") + 1)), "at", 5, 600)
    return drain(stateful.review_stream(acts, cells(t), columns(t), "10 minutes")).select("project_id", "study", "key", "seq", "action", "refusal")


_LATEST = "(SELECT epoch_us(max(ts)) // 1000 FROM events)"


@query("stream_idle", f"""SELECT 'p' AS project_id, user_id || '@' || substr(CAST(ts AS STRING), 1, 10) AS extraction_id, epoch_us(max(ts)) // 1000 AS last_seen FROM events
GROUP BY ALL HAVING bool_and(event_type <> 'purchase') AND epoch_us(max(ts)) // 1000 + 1800000 <= {_LATEST} - 60000""")
def stream_idle(t: Tables) -> DataFrame:
    """A run is a user's day; a purchase ends it, and half an hour without events leaves it idle."""
    run = F.concat(F.col("user_id").cast("string"), F.lit("@"), F.substring(F.col("ts").cast("string"), 1, 10))
    progress = t.stream("events").select(
        F.lit("p").alias("project_id"), run.alias("extraction_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("finished"))
    return drain(stateful.idle_stream(progress)).select("project_id", "extraction_id", F.unix_millis("last_seen").alias("last_seen"))


@query("stream_log_monitor", f"WITH {_LOG} SELECT origen, count(*) AS lines, count(*) FILTER (nivel = 'ERROR') AS errors FROM g GROUP BY ALL")
def stream_log_monitor(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    _log_lines(t).select("value").write.text(f"{folder}/log")
    return drain(ev.log_monitor(logs.stream_log(t.spark, f"{folder}/log")), "complete")


@query("outbox_delivery", """WITH e AS (SELECT event_id, CAST(user_id % 5 AS VARCHAR) AS project_id, CASE event_type WHEN 'view' THEN 'ArticuloCargado' WHEN 'click' THEN 'LibroPublicado' WHEN 'error' THEN 'ExtraccionCompletada' ELSE 'Otro' END AS name,
  event_type = 'error' AND event_id % 4 = 0 AS bad, user_id FROM events)
SELECT name, count(*) FILTER (NOT bad) AS delivered, count(*) FILTER (bad) AS dead,
  CASE name WHEN 'LibroPublicado' THEN (SELECT count(*) FROM (SELECT DISTINCT project_id, user_id % 50 AS row_no FROM e WHERE project_id IN (SELECT project_id FROM e WHERE name = 'LibroPublicado')))
    WHEN 'ExtraccionCompletada' THEN (SELECT count(DISTINCT (project_id, user_id)) FROM e WHERE name = 'ExtraccionCompletada' AND NOT bad) ELSE 0 END AS written
FROM e GROUP BY name""")
def outbox_delivery(t: Tables) -> DataFrame:
    """Events to their handlers. A published codebook marks the rows of its project as outdated; a completed coding puts its cells
    into the matrix, where every fourth is refused and ends as a dead letter after its tries."""
    folder = shared_folder(t.spark)
    kind = F.col("event_type")
    name = F.when(kind == "view", "ArticuloCargado").when(kind == "click", "LibroPublicado").when(kind == "error", "ExtraccionCompletada").otherwise("Otro")

    def outbox(df: DataFrame) -> DataFrame:
        return df.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("string").alias("project_id"), name.alias("name"), F.col("user_id").cast("string").alias("data"))

    rows = t.read("events").select((F.col("user_id") % 5).cast("string").alias("project_id"), (F.col("user_id") % 50).alias("row_no")).distinct()

    def cells_of(events: DataFrame) -> DataFrame:
        return events.select("id", "project_id", F.col("data").cast("long").alias("study"), F.lit("Muestra").alias("key"), F.col("id").alias("value"))

    handlers = {
        "LibroPublicado": ev.outdated_handler(rows, f"{folder}/outdated"),
        "ExtraccionCompletada": ev.cells_handler(cells_of, ["project_id", "study", "key"], f"{folder}/cells", refuse=F.col("id") % 4 == 0, reason="ValueError: no"),
    }
    ev.start_outbox(outbox(t.stream("events")), handlers, f"{folder}/outcomes", f"{folder}/state", once=True).awaitTermination()
    outcomes = ev.outcomes(t.spark, f"{folder}/outcomes")
    state = ev.delivery_state(outbox(t.read("events")), outcomes)
    dead = ev.dead_letters(state).select("id").withColumn("dead", F.lit(True))
    written = t.spark.createDataFrame([("LibroPublicado", ev.written(t.spark, f"{folder}/outdated", ["project_id", "row_no"]).count()),
                                       ("ExtraccionCompletada", ev.written(t.spark, f"{folder}/cells", ["project_id", "study", "key"]).count())], "name string, written long")
    counted = state.join(dead, "id", "left").groupBy("name").agg(F.count_if("delivered").alias("delivered"), F.count_if(F.coalesce("dead", F.lit(False))).alias("dead"))
    return counted.join(written, "name", "left").select("name", "delivered", "dead", F.coalesce("written", F.lit(0)).alias("written"))


@query("pending_events", """SELECT event_id AS id FROM events WHERE event_type <> 'view' AND NOT (event_type = 'error') ORDER BY event_id LIMIT 50""")
def pending_events(t: Tables) -> DataFrame:
    """Next batch when views were delivered and errors have used up their attempts."""
    e = t.read("events")
    tries = F.when(F.col("event_type") == "view", F.array(F.lit(True))).when(F.col("event_type") == "error", F.array_repeat(F.lit(False), 5)).otherwise(F.array(F.lit(False)))
    outcomes = e.select(F.col("event_id").alias("id"), F.explode(tries).alias("ok"), F.lit(None).cast("string").alias("error"))
    state = ev.delivery_state(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("name")), outcomes)
    return ev.pending_events(state).select("id")


@query("unverifiable_feed")
def unverifiable_feed(t: Tables) -> DataFrame:
    """Citations without a place, read from a stored stream of anchors."""
    from quoteloom.operators.anchoring import anchor
    from quoteloom.plans.derived import evidence, stored_blocks

    b = stored_blocks(t)
    anchors = anchor(evidence(t, b), b)
    folder = shared_folder(t.spark)
    anchors.write.parquet(f"{folder}/anchors")
    return drain(ev.unverifiable_feed(t.spark.readStream.schema(anchors.schema).parquet(f"{folder}/anchors")))
