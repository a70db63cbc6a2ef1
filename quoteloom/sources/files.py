"""Folders of files and their first check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quoteloom.functions.text import as_col
from quoteloom.operators.library import fingerprint, mark_duplicates
from quoteloom.session import cut_lineage

NOT_A_PDF = "El archivo no es un PDF"


_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _described(files: DataFrame, project_id: str | None) -> DataFrame:
    """Files of the binary source, with fingerprint and magic check; the bytes do not leave the scan. Without a project the folder of a file names it."""
    parts = F.split("path", "/")
    project = F.element_at(parts, -2) if project_id is None else F.lit(project_id)
    return describe_files(files.select(project.alias("project_id"), F.element_at(parts, -1).alias("file_name"), "content", F.element_at(parts, -1).alias("arrival")))


def load_folder(spark: SparkSession, path: str, project_id: str | None = None, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder, of all folders below it where these name the projects."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return _described((reader.option("recursiveFileLookup", True) if project_id is None else reader).load(path), project_id)


def stream_folder(spark: SparkSession, path: str, project_id: str | None = None, pattern: str = "*.pdf", at_once: int | None = None) -> DataFrame:
    """The same over files as they arrive, at most so many in a micro-batch."""
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema(_FILE)
    if at_once is not None:
        reader = reader.option("maxFilesPerTrigger", at_once)
    return _described((reader.option("recursiveFileLookup", True) if project_id is None else reader).load(path), project_id)


def load_stream(files: DataFrame, ledger: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Loads files as they arrive: each micro-batch against the ledger of fingerprints that earlier ones loaded.

    The checkpoint knows the files seen, so a restart reads new ones only. A batch writes its outcomes under its number, in place
    of what a stopped run of it may have left, and reads only what batches before it wrote. See ``ledger_outcomes``.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = cut_lineage(batch)
        known = None
        if number:
            before = spark.read.schema(f"{LEDGER}, batch int").parquet(ledger).filter(F.col("batch") < number)
            known = before.filter("outcome = 'loaded'").select("project_id", "sha256", "file_name")
        load_outcomes(fresh, known).select(*(c.split(" ")[0] for c in LEDGER.split(", "))).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    writer = files.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


LEDGER = "project_id string, file_name string, document int, sha256 string, outcome string, duplicate_of string, error string"


def ledger_outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """Each file ever loaded through ``load_stream`` with its outcome."""
    return spark.read.schema(f"{LEDGER}, batch int").parquet(ledger).drop("batch")


def describe_files(files: DataFrame) -> DataFrame:
    """``files``: project_id, file_name, arrival, content. Content is reduced to its fingerprint and kind."""
    content = F.col("content").cast("binary")
    return files.select(
        "project_id", "file_name", "arrival", fingerprint(content).alias("sha256"),
        (F.hex(F.substring(content, 1, 4)) == F.hex(F.lit("%PDF"))).alias("is_pdf"), document_number("file_name").alias("document"))


def document_number(file_name: Column | str) -> Column:
    """Number a file name starts with, as in ``3. Author 2022.pdf``."""
    return F.regexp_extract(as_col(file_name), r"^\s*(\d+)\s*[.\-_ ]", 1).try_cast("int")


def load_outcomes(files: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Each file as loaded, duplicate (of which) or error."""
    fine = mark_duplicates(files.filter("is_pdf"), catalogue).withColumn("error", F.lit(None).cast("string"))
    bad = files.filter("not is_pdf").withColumns({"outcome": F.lit("error"), "duplicate_of": F.lit(None).cast("string"), "error": F.lit(NOT_A_PDF)})
    return fine.unionByName(bad)
