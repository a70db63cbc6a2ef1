"""Wide sheets of a current matrix, as rows of cell texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.typed import float_cell, int_cell, text_cell


def header_differences(raw: DataFrame, columns: DataFrame) -> DataFrame:
    """Catalogue headers that a sheet does not carry at their position.

    ``raw``: project_id, sheet, row_no, cells (array of text). Row 1 is the header.
    """
    header = raw.filter("row_no = 1").select("project_id", "sheet", F.posexplode("cells").alias("_i", "found"))
    header = header.withColumn("position", F.col("_i") + 1).drop("_i")
    sheets = raw.select("project_id", "sheet").distinct()
    wanted = sheets.join(columns.select("project_id", "position", "letter", F.col("header").alias("wanted")), "project_id")
    joined = wanted.join(header, ["project_id", "sheet", "position"], "left").filter(~F.col("wanted").eqNullSafe(F.col("found")))
    message = F.format_string("%s: se esperaba %s y hay %s", "letter", "wanted", F.coalesce("found", F.lit("None")))
    return joined.select("project_id", "sheet", "position", message.alias("problem"))


def matching_sheets(raw: DataFrame, columns: DataFrame) -> DataFrame:
    """First sheet, by name, whose headers all match, per project."""
    broken = header_differences(raw, columns).select("project_id", "sheet").distinct()
    good = raw.select("project_id", "sheet").distinct().join(broken, ["project_id", "sheet"], "left_anti")
    return good.groupBy("project_id").agg(F.min("sheet").alias("sheet"))


def mismatch_report(differences: DataFrame, first: int | None = None) -> DataFrame:
    """One text per sheet with its differences, or the first of them."""
    listed = F.array_sort(F.collect_list(F.struct("position", "problem")))
    listed = listed if first is None else F.slice(listed, 1, first)
    return differences.groupBy("project_id", "sheet").agg(F.array_join(F.transform(listed, lambda x: x["problem"]), "; ").alias("report"))


def sheet_cells(raw: DataFrame, columns: DataFrame, chosen: DataFrame) -> DataFrame:
    """Typed cells of the catalogue columns; rows without any value are skipped.

    The values of a row stay together until the empty rows are gone, so nothing is shuffled but the small side.
    """
    body = raw.filter("row_no > 1").join(chosen, ["project_id", "sheet"])
    text = F.nullif(F.get("cells", F.col("position") - 1), F.lit(""))
    filled = body.filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    long = filled.join(columns.select("project_id", "key", "position"), "project_id").select("project_id", "sheet", "row_no", "key", "position", text.alias("_t"))
    return long.select("project_id", "sheet", "row_no", "key", "position", typed_text("_t").alias("value")).filter("row_no is not null")


def typed_text(name: str):
    """Cell of a sheet text: whole numbers, numbers, else text."""
    t = F.col(name)
    return (
        F.when(t.rlike(r"^-?\d+$"), int_cell(t))
        .when(t.rlike(r"^-?\d*\.\d+$"), float_cell(t.try_cast("double")))
        .otherwise(text_cell(t))
    )
