"""Token, cost and progress reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import as_col
from quoteloom.vocab import LOG_RANK, QUOTA_MARKERS, RECENT_MINUTES, ROLES, TOKENS_PER_ARTICLE_FALLBACK

EXT = ["project_id", "extraction_id"]
TOKEN_FIELDS = ["input", "cache_write", "cache_read", "output"]


def usage_by_role(calls: DataFrame) -> DataFrame:
    """Calls, token sums, cost, seconds and calls per model for each extraction and role.

    ``calls``: project_id, extraction_id, role, model, input, cache_write, cache_read, output, cost_usd, seconds.
    Models are counted first, so the map is built from one row per model.
    """
    sums = [F.sum(F.coalesce(f, F.lit(0))).alias(f) for f in TOKEN_FIELDS]
    sums += [F.sum(F.coalesce(f, F.lit(0.0))).alias(f) for f in ("cost_usd", "seconds")]
    per_model = calls.groupBy(*EXT, "role", "model").agg(F.count("*").alias("calls"), *sums)
    entry = F.when(F.col("model").isNotNull(), F.struct("model", "calls"))
    out = per_model.groupBy(*EXT, "role").agg(
        F.sum("calls").alias("calls"), *[F.sum(f).alias(f) for f in TOKEN_FIELDS],
        F.bround(F.sum("cost_usd"), 4).alias("cost_usd"), F.bround(F.sum("seconds"), 1).alias("seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("models"),
    )
    return out


def extraction_totals(by_role: DataFrame) -> DataFrame:
    tokens = sum((F.col(f) for f in TOKEN_FIELDS[1:]), F.col(TOKEN_FIELDS[0]))
    return by_role.groupBy(*EXT).agg(F.sum(tokens).alias("tokens"), F.bround(F.sum("cost_usd"), 4).alias("cost_usd"))


def month_tokens(extractions: DataFrame, now: Column) -> DataFrame:
    """Tokens of extractions still running or ended since the first of the month (UTC); ``extractions`` has tokens."""
    running = F.col("ended").isNull() | (F.col("ended") >= F.date_trunc("month", now))
    return extractions.filter(running).groupBy("project_id").agg(F.sum("tokens").alias("tokens"))


def latest_per_article(extractions: DataFrame, completed: bool = False) -> DataFrame:
    """Latest extraction of each article, of any state or only completed ones."""
    chosen = extractions.filter("state = 'COMPLETADA'") if completed else extractions
    fields = [c for c in extractions.columns if c not in ("project_id", "article_id")]
    best = chosen.groupBy("project_id", "article_id").agg(
        F.max_by(F.struct(*fields), F.struct("started", "extraction_id")).alias("_last"))
    return best.select("project_id", "article_id", "_last.*")


def tokens_per_article(extractions: DataFrame, projects: DataFrame) -> DataFrame:
    """Mean tokens over each article's latest extraction if completed; a measured constant without any."""
    measured = latest_per_article(extractions).filter("state = 'COMPLETADA' and tokens > 0")
    means = measured.groupBy("project_id").agg(F.bround(F.avg("tokens"), 0).cast("bigint").alias("_mean"))
    return projects.select("project_id").join(means, "project_id", "left").select(
        "project_id", F.coalesce("_mean", F.lit(TOKENS_PER_ARTICLE_FALLBACK)).alias("estimate"))


def budget_gate(requests: DataFrame, used: DataFrame, estimates: DataFrame) -> DataFrame:
    """Whether each batch fits its monthly cap; ``requests``: project_id, articles, cap (null: none)."""
    joined = requests.join(used, "project_id", "left").join(estimates, "project_id")
    needed = F.coalesce("tokens", F.lit(0)) + F.col("articles") * F.col("estimate")
    return joined.select(
        "project_id", "articles", needed.alias("needed"), "cap", (F.col("cap").isNull() | (needed <= F.col("cap"))).alias("accepted"))


def recent_extractions(extractions: DataFrame, now: Column, minutes: int = RECENT_MINUTES) -> DataFrame:
    """Running extractions and those ended in the last minutes."""
    return extractions.filter(F.col("ended").isNull() | (F.col("ended") >= now - F.make_interval(mins=F.lit(minutes))))


def models_of_latest(extractions: DataFrame, by_role: DataFrame) -> DataFrame:
    """Models per role in the latest run of each article, roles without calls shown, and whether any was recorded."""
    last = latest_per_article(extractions).select("project_id", "article_id", "extraction_id", "state")
    roles = last.select("*", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    joined = roles.join(by_role.select(*EXT, "role", "models"), [*EXT, "role"], "left")
    recorded = joined.groupBy("project_id", "article_id").agg(F.bool_or(F.coalesce(F.size("models") > 0, F.lit(False))).alias("recorded"))
    return joined.join(recorded, ["project_id", "article_id"])


def level_rank(level: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in LOG_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, as_col(level)), F.lit(0))


def filter_log(log: DataFrame, minimum: str | None = None, origin: str | None = None, search: str = "") -> DataFrame:
    """Log lines from a level up, of one origin, with a text; works on a stream as well."""
    out = log
    if minimum is not None:
        out = out.filter(level_rank("nivel") >= LOG_RANK[minimum])
    if origin is not None:
        out = out.filter(F.col("origen") == origin)
    if search.strip():
        out = out.filter(F.lower("mensaje").contains(search.strip().lower()))
    return out


def log_origins(log: DataFrame) -> DataFrame:
    """Distinct origins with their lines and errors."""
    return log.groupBy("origen").agg(F.count("*").alias("lines"), F.count_if(level_rank("nivel") >= 2).alias("errors"))


def quota_windows(runs: DataFrame) -> DataFrame:
    """Use of the 5-hour and 7-day windows of each run, whether it is blocked or exhausted, and when it resets.

    ``runs``: run_id, info (JSON text of the last limit event, may be null), message.
    """
    single = F.get_json_object("info", "$.rateLimitType")
    windows = F.from_json(F.get_json_object("info", "$.unifiedWindows"), "map<string, struct<utilization: double, resetsAt: bigint>>")
    # older runs report one window outside the map
    own = F.struct(
        F.get_json_object("info", "$.utilization").try_cast("double").alias("utilization"),
        F.get_json_object("info", "$.resetsAt").try_cast("bigint").alias("resetsAt"))
    parsed = runs.withColumn("_map", windows).withColumn(
        "_w", F.when(F.coalesce(F.size("_map"), F.lit(0)) > 0, F.col("_map")).when(single.isNotNull(), F.create_map(single, own)))
    status = F.get_json_object("info", "$.status")
    marked = F.lower(F.coalesce("message", F.lit(""))).rlike("|".join(QUOTA_MARKERS))
    full = F.filter(F.map_values(F.col("_map")), lambda w: F.coalesce(w["utilization"], F.lit(0.0)) >= 1)
    exhausted = F.coalesce(status == "rejected", F.lit(False)) | marked
    resets = F.coalesce(
        F.get_json_object("info", "$.resetsAt").try_cast("bigint"),
        F.array_max(F.transform(full, lambda w: F.coalesce(w["resetsAt"], F.lit(0)))))

    def used(name: str) -> Column:
        return F.bround(F.col("_w")[name]["utilization"] * 100, 1)

    return parsed.select(
        "run_id", used("five_hour").alias("used_5h"), used("seven_day").alias("used_7d"),
        F.timestamp_seconds(F.nullif(F.col("_w")["five_hour"]["resetsAt"], F.lit(0))).alias("resets_5h"),
        F.timestamp_seconds(F.nullif(F.col("_w")["seven_day"]["resetsAt"], F.lit(0))).alias("resets_7d"),
        (status.isNotNull() & ~status.isin("allowed", "allowed_warning")).alias("blocked"),
        exhausted.alias("exhausted"), F.when(exhausted, F.timestamp_seconds(F.nullif(resets, F.lit(0)))).alias("resets_at"),
    )


def library_projection(articles: DataFrame, seconds_per_page: tuple[float, float], cost_per_article: float) -> DataFrame:
    """Hours of conversion (best and worst rate) and cost of extraction for each project's library."""
    low, high = seconds_per_page
    return articles.groupBy("project_id").agg(F.count("*").alias("articles"), F.sum("pages").alias("pages")).select(
        "project_id", "articles", "pages", (F.col("pages") * low / 3600).alias("hours_low"), (F.col("pages") * high / 3600).alias("hours_high"),
        (F.col("articles") * cost_per_article).alias("cost_usd"))


def relaunch_inputs(articles: DataFrame, extractions: DataFrame) -> DataFrame:
    """Input data of the last attempt that carries any, per article, and whether something is missing to relaunch.

    ``extractions`` carries input STRUCT<document, first_study, covidence, route>.
    """
    carrying = extractions.filter("input.document is not null")
    last = carrying.groupBy("project_id", "article_id").agg(F.max_by("input", F.struct("started", "extraction_id")).alias("input"))
    joined = articles.select("project_id", "article_id").join(last, ["project_id", "article_id"], "left")
    route = F.coalesce(F.nullif("input.route", F.lit("")), F.lit("Covidence"))
    incomplete = F.col("input").isNull() | (F.col("input.covidence").isNull() & (route == "Covidence"))
    return joined.withColumn("incomplete", incomplete)
