"""Coded output: arrays of ``{fila, trazabilidad}`` as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions.canonical import response_json
from quoteloom.functions.typed import variant_cell
from quoteloom.schemas import TRACE


def read_coded_files(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    """One text per file; the file name is the extraction. Without a project the folder of a file names it."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", project_id is None).option("pathGlobFilter", "*.json").text(path)
    project = F.element_at(F.split("_metadata.file_path", "/"), -2) if project_id is None else F.lit(project_id)
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "")
    return texts.select(project.alias("project_id"), name.alias("extraction_id"), name.alias("doc_id"), F.col("value").alias("content"))


def coded_rows(outputs: DataFrame, tolerant: bool = False) -> DataFrame:
    """One row per coded effect. ``outputs``: project_id, extraction_id, doc_id, content.

    ``tolerant`` accepts fences and text around the JSON, as model responses carry.
    """
    text = response_json("content") if tolerant else F.col("content")
    parsed = outputs.withColumn("_text", text).withColumn("_v", F.try_parse_json("_text")).filter("_v is not null")
    one = F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))
    items = F.when(one, F.array("_v")).otherwise(F.expr("try_cast(_v as array<variant>)"))
    rows = parsed.select("project_id", "extraction_id", "doc_id", F.posexplode(items).alias("row_pos", "_item"))
    return rows.select("project_id", "extraction_id", "doc_id", "row_pos", fila_of(F.col("_item")).alias("fila"), traz_of(F.col("_item")).alias("traz"))


def fila_of(item: Column) -> Column:
    values = F.try_variant_get(item, "$.fila", "map<string,variant>")
    return F.transform_values(values, lambda _, v: variant_cell(v))


def traz_of(item: Column) -> Column:
    return F.from_json(F.to_json(F.try_variant_get(item, "$.trazabilidad", "variant")), TRACE)
