"""Running totals in document order without sorting a whole document in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.session import cut_lineage


def running_sum(df: DataFrame, keys: list[str], position: str, value: Column, name: str, width: int = 1024) -> DataFrame:
    """Adds ``name`` = sum of ``value`` up to and including the row, per key, by position.

    Two levels: each bucket of ``width`` positions is summed and the bucket totals are accumulated; inside a
    bucket a window adds the rest. A key holding a third of all rows spreads over its buckets.
    """
    bucket = F.floor(F.col(position) / F.lit(width))
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_part", F.sum("_value").over(inside))
        .join(totals, [*keys, "_bucket"])
        .withColumn(name, F.col("_base") + F.col("_part"))
        .drop("_bucket", "_value", "_part", "_base")
    )


def carry_last(df: DataFrame, keys: list[str], position: str, value: Column, name: str, width: int = 1024, ties: Column | None = None) -> DataFrame:
    """Adds ``name`` = last non-null ``value`` strictly before the row, per key, by position (two levels as above).

    Rows of one position come by ``ties``; without it Spark puts them in any order, which differs from run to run.
    """
    bucket = F.floor(F.col(position) / F.lit(width))
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    ends = marked.filter("_value is not null").groupBy(*keys, "_bucket").agg(F.max_by("_value", position).alias("_end"))
    buckets = marked.select(*keys, "_bucket").distinct().join(ends.hint("merge"), [*keys, "_bucket"], "left")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_base", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    order = [position] if ties is None else [F.col(position), ties]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
        .join(buckets.hint("merge"), [*keys, "_bucket"])
        .withColumn(name, F.coalesce("_near", "_base"))
        .drop("_bucket", "_value", "_near", "_base")
    )


def in_ranges(df: DataFrame, order: Sequence[Column], name: str = "_range") -> DataFrame:
    """The rows dealt to the ranges of one global order, with the number of their range, written once.

    Spark samples the limits of the ranges, so they hold about equally many rows whatever key is frequent, as long as ``order``
    tells rows apart. Writing fixes the numbers: later readers see the same range however often tasks are repeated.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def ranged_sums(dealt: DataFrame, keys: list[str], order: Sequence[Column], values: dict[str, Column], name: str = "_range") -> DataFrame:
    """Adds running sums (up to and including the row, per key) to rows that ``in_ranges`` dealt by ``keys`` and ``order``.

    Rows are sorted inside their range only; across ranges the sums of (range, key) are accumulated, of which a key has one per
    range. Keys hold no nulls (wrap them in a struct); rows that ``order`` does not tell apart come in any order.
    """
    marked = dealt.select("*", *(v.alias(f"_v_{k}") for k, v in values.items()))
    parts = marked.groupBy(name, *keys).agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values))
    before = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(name, *keys, *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values))
    inside = Window.partitionBy(name, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.select("*", *(F.sum(f"_v_{k}").over(inside).alias(f"_s_{k}") for k in values)).join(parts, [name, *keys])
    return summed.select(*dealt.columns, *((F.col(f"_b_{k}") + F.col(f"_s_{k}")).alias(k) for k in values))
