"""Domain events and logs as streams: outbox delivery, routing, dedup, feeds and monitors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quoteloom.operators.usage import level_rank
from quoteloom.session import cut_lineage
from quoteloom.vocab import MAX_DELIVERY_ATTEMPTS, OUTBOX_BATCH

#: Takes its events and the name of the delivery, under which a repeated call replaces what the first one wrote.
Handler = Callable[[DataFrame, str], DataFrame]
OUTCOME = "id bigint, ok boolean, error string"


# ------------------------------------------------------------------ outbox
def delivery_state(outbox: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events with their failed attempts and whether they were delivered; ``outcomes``: id, ok, error."""
    tried = outcomes.groupBy("id").agg(F.count_if(~F.col("ok")).alias("attempts"), F.bool_or("ok").alias("delivered"), F.max("error").alias("error"))
    return outbox.join(tried, "id", "left").withColumns(
        {"attempts": F.coalesce("attempts", F.lit(0)), "delivered": F.coalesce("delivered", F.lit(False))})


def pending_events(state: DataFrame, batch: int = OUTBOX_BATCH) -> DataFrame:
    """Next batch: undelivered, attempts left, oldest first."""
    return state.filter((~F.col("delivered")) & (F.col("attempts") < MAX_DELIVERY_ATTEMPTS)).orderBy("id").limit(batch)


def dead_letters(state: DataFrame) -> DataFrame:
    return state.filter((~F.col("delivered")) & (F.col("attempts") >= MAX_DELIVERY_ATTEMPTS))


def route(events: DataFrame, name: str) -> DataFrame:
    """Events of one name, with their project and name inside the data."""
    return events.filter(F.col("name") == name)


def deliver(events: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """Outcome of each event: that of its handler, or delivered when nobody listens to its name.

    A handler maps its events and the name of their delivery to (id, ok, error).
    """
    out = _unheard(events, handlers)
    for name, handler in handlers.items():
        out = out.unionByName(handler(route(events, name), name).select("id", "ok", "error"))
    return out


def _unheard(events: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    others = events.filter(~F.coalesce(F.col("name").isin(list(handlers)), F.lit(False)))
    return others.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


def _complete(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delivered_apart(events: DataFrame, handlers: dict[str, Handler], folder: str, delivery: str) -> DataFrame:
    """Outcomes of a batch, each handler by itself: one that raises fails its own events, with its message.

    ``folder`` is the ledger: the outcomes of a handler are a table in it, complete once the handler has done its work. A batch that
    starts over finds it and does not call the handler again. One that was stopped before is called with the same ``delivery``,
    under which it replaces what it wrote.
    """
    spark = events.sparkSession
    every = _unheard(events, handlers)
    for name, handler in handlers.items():
        own, entry = route(events, name), f"{folder}/{name}"
        if not _complete(spark, entry):
            if own.isEmpty():
                continue
            try:
                outcome = cut_lineage(handler(own, f"{delivery}-{name}").select("id", "ok", "error"))
            except Exception as e:  # noqa: BLE001 - whatever a handler raises is the outcome of its events
                outcome = own.select("id", F.lit(False).alias("ok"), F.lit(f"{type(e).__name__}: {e}").alias("error"))
            outcome.write.mode("overwrite").parquet(entry)
        every = every.unionByName(spark.read.schema(OUTCOME).parquet(entry))
    return every


def start_outbox(events: DataFrame, handlers: dict[str, Handler], outcomes_path: str, checkpoint: str, retries: int = MAX_DELIVERY_ATTEMPTS,
                 once: bool = False) -> StreamingQuery:
    """Delivers each micro-batch, retries its failures, and writes every outcome to a table by batch and attempt.

    The checkpoint repeats a batch that was stopped under its number, so with the ledger every delivery takes effect once.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark, open_ = batch.sparkSession, batch
        for attempt in range(retries):
            entry = f"batch={number}/attempt={attempt}"
            found = delivered_apart(open_, handlers, f"{outcomes_path}/ledger/{entry}", f"{number}-{attempt}")
            if not _complete(spark, f"{outcomes_path}/done/{entry}"):
                found.write.mode("overwrite").parquet(f"{outcomes_path}/done/{entry}")
            failed = spark.read.schema(OUTCOME).parquet(f"{outcomes_path}/done/{entry}").filter("not ok").select("id")
            if failed.isEmpty():
                return
            open_ = batch.join(failed, "id", "left_semi")

    writer = events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def outcomes(spark: SparkSession, outcomes_path: str) -> DataFrame:
    """All outcomes that ``start_outbox`` wrote: id, ok, error."""
    return spark.read.schema(OUTCOME).option("recursiveFileLookup", True).parquet(f"{outcomes_path}/done")


# ------------------------------------------------------------------ handlers
def outdated_handler(rows: DataFrame, path: str) -> Handler:
    """A published codebook: the matrix rows of its project become outdated. ``rows``: project_id and the key of a row."""

    def handle(events: DataFrame, delivery: str) -> DataFrame:
        hit = rows.join(events.select("project_id").distinct(), "project_id", "left_semi")
        hit.write.mode("overwrite").parquet(f"{path}/delivery={delivery}")
        return events.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    return handle


def cells_handler(cells_of: Callable[[DataFrame], DataFrame], keys: list[str], path: str, refuse: Column | None = None, reason: str = "") -> Handler:
    """A completed coding: its cells go into the matrix by key, the last event of a key winning. ``cells_of`` gives id, keys and values.

    Events for which ``refuse`` holds fail with ``reason`` and write nothing.
    """

    def handle(events: DataFrame, delivery: str) -> DataFrame:
        bad = F.coalesce(refuse, F.lit(False)) if refuse is not None else F.lit(False)
        new = cells_of(events.filter(~bad))
        values = [c for c in new.columns if c not in keys]
        last = new.groupBy(*keys).agg(F.max_by(F.struct(*values), "id").alias("_v")).select(*keys, "_v.*")
        last.write.mode("overwrite").parquet(f"{path}/delivery={delivery}")
        return events.select("id", (~bad).alias("ok"), F.when(bad, F.lit(reason)).alias("error"))

    return handle


def written(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What the handlers wrote, one row per key: that of the largest id, where there are ids."""
    every = spark.read.option("mergeSchema", True).parquet(path)
    if "id" not in every.columns:
        return every.select(*keys).distinct()
    values = [c for c in every.columns if c not in (*keys, "delivery")]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*values), "id").alias("_v")).select(*keys, "_v.*")


# ------------------------------------------------------------------ stateless and built-in stateful streams
def dedup_files(files: DataFrame, within: str | None = None, event_time: str = "arrived") -> DataFrame:
    """First file of each fingerprint per project. With ``within`` the state is bounded, and a copy that comes later
    than that passes again."""
    key = ["project_id", "sha256"]
    if within is None:
        return files.dropDuplicates(key)
    return files.withWatermark(event_time, within).dropDuplicatesWithinWatermark(key)


def unverifiable_feed(anchors: DataFrame) -> DataFrame:
    """Citations that could not be verified, as they are completed."""
    return anchors.filter("level = 'NO_VERIFICABLE'").select("project_id", "extraction_id", "study", "column", "ev_idx")


def log_monitor(log: DataFrame, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Lines and errors per origin. The optional event-time window is an addition of this library."""
    counts = [F.count("*").alias("lines"), F.count_if(level_rank("nivel") >= 2).alias("errors")]
    if window is None:
        return log.groupBy("origen").agg(*counts)
    w = log.withWatermark("t", late).groupBy(F.window("t", window), "origen").agg(*counts)
    return w.select(F.col("window.start").alias("start"), "origen", "lines", "errors")
