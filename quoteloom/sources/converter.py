"""Output of the PDF converter: a list of items and the sizes of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.schemas import CONTENT_ITEM, MIDDLE

DOC = ["project_id", "doc_id"]
INCOMPLETE = "la salida del conversor no trae content_list.json y middle.json"


def read_converter_folder(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    """One row per document folder with the two texts; a missing file leaves its text null. Without a project the folder above names it."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    project = F.element_at(parts, -3) if project_id is None else F.lit(project_id)
    named = texts.select("value", project.alias("project_id"), F.element_at(parts, -2).alias("doc_id"), F.element_at(parts, -1).alias("_file"))
    return named.groupBy(*DOC).agg(
        F.max(F.when(F.col("_file") == "content_list.json", F.col("value"))).alias("content_list"),
        F.max(F.when(F.col("_file") == "middle.json", F.col("value"))).alias("middle"),
    )


def complete_outputs(raw: DataFrame) -> DataFrame:
    return raw.filter("content_list is not null and middle is not null")


def rejected_outputs(raw: DataFrame) -> DataFrame:
    """Documents without one of the two parts."""
    return raw.filter("content_list is null or middle is null").select(*DOC, F.lit(INCOMPLETE).alias("problem"))


def converter_items(raw: DataFrame) -> DataFrame:
    """Items in their order; ``raw``: project_id, doc_id, content_list, middle."""
    items = F.from_json("content_list", f"array<{CONTENT_ITEM}>")
    return complete_outputs(raw).select(*DOC, F.posexplode(items).alias("pos", "i")).select(*DOC, "pos", "i.*")


def converter_pages(raw: DataFrame) -> DataFrame:
    sizes = F.from_json("middle", MIDDLE)
    return complete_outputs(raw).select(*DOC, F.explode(sizes["pdf_info"]).alias("p")).select(
        *DOC, (F.col("p.page_idx") + 1).alias("page"), F.get("p.page_size", F.lit(0)).alias("width_pt"), F.get("p.page_size", F.lit(1)).alias("height_pt"))
