"""Recorded model runs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_results(lines: DataFrame) -> DataFrame:
    """Result and last limit info of each run, as JSON text; ``lines``: run_id, line_no, line. Other lines are ignored."""
    text = F.trim("line")
    objects = lines.withColumn("_o", text).filter(F.startswith("_o", F.lit("{"))).filter(F.try_parse_json("_o").isNotNull())
    kind = F.get_json_object("_o", "$.type")
    info = F.get_json_object("_o", "$.rate_limit_info")
    limit = (kind == "rate_limit_event") & F.startswith(info, F.lit("{"))
    found = objects.groupBy("run_id").agg(
        F.max_by("_o", F.when(kind == "result", F.col("line_no"))).alias("result"),
        F.max_by(info, F.when(limit, F.col("line_no"))).alias("info"))
    return lines.select("run_id").distinct().join(found, "run_id", "left")
