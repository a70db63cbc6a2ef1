"""Event logs: JSON lines, read whole, from a place on, or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.schemas import LOG
from quoteloom.vocab import LOG_BATCH, LOG_OPEN_TAIL


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """New lines as files arrive; the checkpoint of the query takes the place of a byte cursor."""
    return parse_log(spark.readStream.text(path))


def parse_log(lines: DataFrame) -> DataFrame:
    """Valid JSON lines as log columns; corrupt lines are skipped. ``lines``: value and own columns."""
    kept = [c for c in lines.columns if c != "value"]
    valid = lines.filter(F.try_parse_json("value").isNotNull())
    return valid.select(*kept, F.from_json("value", LOG, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"}).alias("l")).select(*kept, "l.*")


def tail(log: DataFrame, order: str, n: int = LOG_OPEN_TAIL) -> DataFrame:
    """The last lines, oldest first."""
    return log.orderBy(F.desc(order)).limit(n).orderBy(order)


def after(log: DataFrame, order: str, cursor: int, n: int = LOG_BATCH) -> DataFrame:
    """Lines after a place, at most a batch."""
    return log.filter(F.col(order) > cursor).orderBy(order).limit(n)
