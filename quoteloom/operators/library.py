"""Library of articles: fingerprints, states, listings and lifecycle checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.text import as_col, blank, natural_key
from quoteloom.operators.ordering import in_ranges, ranged_sums
from quoteloom.vocab import ARTICLE_MOVES, ARTICLE_STATES, EXCLUDABLE, INTERMEDIATE, QUEUEABLE

ARTICLE = ["project_id", "article_id"]
SALTS = 8


def fingerprint(content: Column | str) -> Column:
    return F.sha2(as_col(content).cast("binary"), 256)


def mark_duplicates(files: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Outcome of loading each file: loaded, or duplicate of the first with the same fingerprint in its project.

    ``files``: project_id, file_name, arrival, sha256. The first file of a fingerprint comes from a partial
    aggregate, so copies of one file never meet in one task; ``catalogue`` holds files loaded before.
    """
    key = ["project_id", "sha256"]
    firsts = files.groupBy(*key).agg(F.min(F.struct("arrival", "file_name")).alias("_first"))
    if catalogue is not None:
        before = catalogue.groupBy(*key).agg(F.min("file_name").alias("_before"))
        firsts = firsts.join(before, key, "left")
    else:
        firsts = firsts.withColumn("_before", F.lit(None).cast("string"))
    # copies of one file are dealt over SALTS tasks, each with its own copy of the small row they look up
    salt = F.pmod(F.xxhash64("arrival", "file_name"), F.lit(SALTS)).cast("int")
    salted = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = files.withColumn("_salt", salt).join(salted, [*key, "_salt"])
    own = F.col("_before").isNull() & (F.col("arrival") == F.col("_first.arrival")) & (F.col("file_name") == F.col("_first.file_name"))
    return joined.select(
        *files.columns, F.when(own, "loaded").otherwise("duplicate").alias("outcome"),
        F.when(~own, F.coalesce("_before", F.col("_first.file_name"))).alias("duplicate_of"),
    )


def outcome_counts(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("project_id", "outcome").agg(F.count("*").alias("n"))


def state_counts(articles: DataFrame) -> DataFrame:
    """Articles per state and project, all states shown."""
    wide = articles.groupBy("project_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ARTICLE_STATES])
    return wide.unpivot("project_id", ARTICLE_STATES, "state", "n")


def list_articles(articles: DataFrame, state: str | None = None, search: str = "") -> DataFrame:
    """Articles by state and by part of the name without case, with their ``rank`` in their project by natural order of file name.

    Ranks come from sampled ranges, so no project is sorted in one task.
    """
    out = articles if state is None else articles.filter(F.col("state") == state)
    if search:
        out = out.filter(F.lower("file_name").contains(search.lower()))
    order = [F.col("sort_key"), F.col("file_name"), F.col("article_id")]
    dealt = in_ranges(out.withColumn("sort_key", natural_key("file_name")), [F.col("project_id"), *order])
    return ranged_sums(dealt, ["project_id"], order, {"rank": F.lit(1)}).drop("_range")


# ------------------------------------------------------------------ lifecycle
def legal_move(prev: Column, new: Column) -> Column:
    """Whether a change of state is in the table of moves; failing and excluding have rules of their own."""
    moves = F.create_map(*[x for s, to in ARTICLE_MOVES.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]))])
    allowed = F.coalesce(F.array_contains(F.try_element_at(moves, prev), new), F.lit(False))
    return F.when(new == "ERROR", prev != "EXCLUIDO").when(new == "EXCLUIDO", prev.isin(EXCLUDABLE)).otherwise(allowed)


def illegal_moves(events: DataFrame) -> DataFrame:
    """State events that do not follow the table, or exclude without a reason.

    ``events``: project_id, article_id, seq, new_state, reason, step (failed step, for ERROR). The previous state
    is that of the event before; a first event must create the article as NUEVO or HEREDADO.
    """
    w = Window.partitionBy(*ARTICLE).orderBy("seq")
    chained = events.withColumns({"prev_state": F.lag("new_state").over(w), "_step": F.lag("step").over(w)})
    prev, new = F.col("prev_state"), F.col("new_state")
    legal = (
        F.when(prev.isNull(), new.isin("NUEVO", "HEREDADO"))
        .when(prev == "ERROR", new.isin("ERROR", "EXCLUIDO", "NUEVO", "LISTO", "HEREDADO", "POR_REVISAR", "APROBADO") | new.eqNullSafe(F.col("_step")))
        .otherwise(legal_move(prev, new))
    )
    unexplained = (new == "EXCLUIDO") & blank("reason")
    problem = F.when(~legal, F.concat(F.lit("Transición inválida: "), F.coalesce(prev, F.lit("-")), F.lit(" → "), new)).when(
        unexplained, "Excluir exige motivo")
    return chained.withColumn("problem", problem).filter("problem is not null").select(*ARTICLE, "seq", "prev_state", "new_state", "problem")


def current_states(events: DataFrame) -> DataFrame:
    """State of each article after its last event, the state it was queued or excluded from, and its error if any."""
    w = Window.partitionBy(*ARTICLE).orderBy("seq")
    chained = events.withColumn("_prev", F.lag("new_state").over(w))
    parked = F.col("new_state").isin("EN_COLA", "EXCLUIDO")
    return chained.groupBy(*ARTICLE).agg(
        F.max_by("new_state", "seq").alias("state"),
        F.max_by("_prev", F.when(parked, F.col("seq"))).alias("prev_state"),
        F.max_by(F.when(F.col("new_state") == "ERROR", F.struct("step", "reason")), "seq").alias("error"),
        F.count("*").alias("changes"),
    )


def reset_target(has_document: Column, prev_state: Column) -> Column:
    return (
        F.when(~has_document, "NUEVO").when(prev_state.isin("HEREDADO", "POR_REVISAR", "APROBADO"), prev_state).otherwise("LISTO")
    )


def reset_errors(articles: DataFrame) -> DataFrame:
    """Articles in ERROR with the state a reset gives them."""
    return articles.filter("state = 'ERROR'").withColumn(
        "target", reset_target(F.coalesce("has_document", F.lit(False)), F.col("prev_state")))


def queue_requests(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """Whether each request may be queued, with the refusal.

    ``requests``: project_id, article_id, covidence, route, confirmed, reason. ``articles``: file_name, state.
    """
    joined = requests.join(articles.select(*ARTICLE, "file_name", "state"), ARTICLE, "left")
    name = F.concat(F.lit("«"), F.col("file_name"), F.lit("»"))
    refusal = (
        F.when(F.col("state").isNull(), "el artículo no existe en el proyecto")
        .when(~F.col("state").isin(QUEUEABLE), F.concat(name, F.lit(" está en estado "), F.col("state"), F.lit(" y no se puede extraer ahora")))
        .when((F.col("state") == "POR_REVISAR") & ~F.coalesce("confirmed", F.lit(False)),
              F.concat(name, F.lit(" ya tiene filas por revisar: confirme la reextracción")))
        .when(F.col("covidence").isNull() & (F.col("route") == "Covidence"),
              F.concat(name, F.lit(": falta Covidence #. Indíquelo, o elija otra vía de identificación si el artículo no pasó por Covidence")))
    )
    return joined.select(*ARTICLE, refusal.isNull().alias("queued"), refusal.alias("refusal"))


def requeue_refusal(articles: DataFrame) -> DataFrame:
    """Domain checks of queueing one article: state, document, confirmation, reason and the failed step.

    ``articles``: state, has_document, confirmed, reason, step (failed step).
    """
    state = F.col("state")
    refusal = (
        F.when(~state.isin("LISTO", "HEREDADO", "ERROR", "POR_REVISAR", "APROBADO"), F.concat(F.lit("Transición inválida: "), state, F.lit(" → EN_COLA")))
        .when(~F.coalesce("has_document", F.lit(False)), "El artículo no tiene documento estructurado: conviértalo antes de extraer")
        .when(state.isin("POR_REVISAR", "APROBADO") & ~F.coalesce("confirmed", F.lit(False)), "Reextraer exige confirmación")
        .when((state == "APROBADO") & blank("reason"), "Reextraer un artículo aprobado exige motivo")
        .when((state == "ERROR") & ~F.coalesce(F.col("step").isin("EN_COLA", "EXTRAYENDO", "AUDITANDO"), F.lit(False)),
              "El error no ocurrió al extraer: use reintentar()")
    )
    return articles.select(*ARTICLE, refusal.alias("refusal"))


def stalled_articles(articles: DataFrame, active_jobs: DataFrame) -> DataFrame:
    """Articles in an intermediate state without an active job."""
    return articles.filter(F.col("state").isin(INTERMEDIATE)).join(active_jobs.select(*ARTICLE), ARTICLE, "left_anti")


def isolation_breaches(child: DataFrame, parent: DataFrame, link: str) -> DataFrame:
    """Child rows whose parent exists, but only in other projects, or nowhere."""
    return child.join(parent.select("project_id", F.col(link)).distinct(), ["project_id", link], "left_anti")
